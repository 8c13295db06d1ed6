"""Print the formatted physical plan of registered queries (to check
exchanges, pushed filters and read schemas). Usage: explain.py name [sf_dir]"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from cyclewise.plans import REGISTRY  # noqa: E402
from cyclewise.session import get_session  # noqa: E402


def main() -> None:
    name = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    df = REGISTRY[name].run(spark, sf_dir)
    df.explain("formatted")


if __name__ == "__main__":
    main()
