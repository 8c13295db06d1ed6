"""Registered queries over the driver's tables: thin wrappers that apply an
operator to its whole table and derive the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sha256, table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, threshold=0.85)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, learn

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn(docs, fold() != 1))
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def _spans_text(c: str):
    """kind:start:end, comma-joined, of an array of spans."""
    return F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _count(c: str, kind: str):
    return F.size(F.filter(c, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal_data import BASE, personal_data

    out = personal_data(table(spark, sf_dir, "documents"))
    base = out.withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    return base.select("doc_id", *(_count("base", k) for k in BASE), sha256(_spans_text("base")).alias("base_sha256"), _spans_text("spans").alias("spans"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256(F.col("text")).alias("kept_sha256"))


OP4_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NULL OR k.doc_id = r.keeper AS stays FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated, decontaminate, n_hit

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        sha256(F.concat_ws(",", "items")).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .main_text import main_text

    out = main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated")


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shard import shuffle_shards

    out = shuffle_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT item_id, ws, least(13, len(ws)) AS n FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, n, array_to_string(ws[s : s + n - 1], ' ') AS win
      FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM i)),
p AS (SELECT doc_id, n, s, array_to_string(ws[s : s + n - 1], ' ') AS win
      FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(ws) >= n)),
m AS (SELECT p.doc_id, p.s, p.n, w.item_id FROM p JOIN w ON p.n = w.n AND p.win = w.win),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import BASE, secrets

    out = secrets(table(spark, sf_dir, "documents"))
    base = out.withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    return base.select("doc_id", *(_count("base", k) for k in BASE), sha256(_spans_text("base")).alias("base_sha256"), _spans_text("spans").alias("spans"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_codec import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spot_signatures import fingerprint, likeness, with_next

    out = with_next(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        sha256(F.col("edited")).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import restore, split

    out = restore(split(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256(F.col("output")).alias("output_sha256"), sha256(F.col("restored")).alias("restored_sha256"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels"), fold() != 1))
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("hits").cast("long").alias("n_hits"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .align_tokens import align, pair_sizes, with_counts

    files = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    out = align(table(spark, sf_dir, "documents"), *files)
    # whole texts of groups are hashed before anything is written
    digest = F.when(F.col("n_groups") > 0, sha256(F.col("groups"))).otherwise("")
    out = with_counts(out.withColumn("groups_sha256", digest).drop("groups"), pair_sizes(*files)[1])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_shared")


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
                  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                  WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
s AS (SELECT *, array_to_string(u[1 : least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS m,
             array_to_string(u[greatest(a, b) + 1 : n], '') AS s FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM s
"""


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_personal_data": op2_personal_data,
    "op3_language": op3_language,
    "op4_line_dedup": op4_line_dedup,
    "op5_main_text": op5_main_text,
    "op6_decontaminate": op6_decontaminate,
    "op7_shard": op7_shard,
    "op8_secrets": op8_secrets,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_fingerprint": op10_fingerprint,
    "op11_fill_middle": op11_fill_middle,
    "op12_toxicity": op12_toxicity,
    "op13_align": op13_align,
}
ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": OP4_SQL,
    "op6_decontaminate": OP6_SQL,
    "op11_fill_middle": OP11_SQL,
}
