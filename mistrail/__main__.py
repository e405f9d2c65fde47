"""spark-submit ... -m mistrail QUERY DATA_DIR [OUT]: runs a query and writes it as Parquet, or shows it; no QUERY lists them."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from mistrail.plans import registry


def main(args: list[str]) -> int:
    queries = registry.queries()
    if len(args) < 2 or args[0] not in queries:
        print(__doc__, *(f"{name}: {(q.__doc__ or '').strip().splitlines()[0] if q.__doc__ else ''}" for name, q in sorted(queries.items())), sep="\n")
        return int(bool(args))
    spark = SparkSession.builder.appName(f"mistrail {args[0]}").getOrCreate()
    result = queries[args[0]](spark, args[1])
    result.write.mode("overwrite").parquet(args[2]) if len(args) > 2 else result.show(50, False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
