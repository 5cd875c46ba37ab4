"""Prints one JSON line with the seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import random
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from strandweave.functions import spec as notation  # noqa: E402
from strandweave.plans import queries  # noqa: E402
from strandweave.plans.trim import Side, TrimSpec, trim  # noqa: E402

#: Times that each synthetic read is taken; long reads, and how many short ones make one (about 20,000 bases).
COPIES, LONG, PIECES = 4, 2000, 360
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def barcodes(n: int = 96, length: int = 8) -> list[tuple[str, str]]:
    rng, out = random.Random(1), []
    while len(out) < n:
        b = "".join(rng.choice("ACGT") for _ in range(length))
        if all(sum(x != y for x, y in zip(b, o)) > 2 for o in out):
            out.append(b)
    return [("front", f"b{i}=^{b}") for i, b in enumerate(out)]


def plans() -> dict:
    one = lambda **k: Side(notation.adapters([("back", queries.ADAPTER)], max_errors=0.1), **k)
    return {
        "native_steps": TrimSpec(Side(cut=[1], quality=(0, 20), length=60, min_length=20), trim_n=True, max_n=2),
        "one_adapter": TrimSpec(one(min_length=20)),
        "quality_and_adapter": TrimSpec(one(quality=(0, 20), min_length=20)),
        "both_strands": TrimSpec(one(), both_strands=True),
        "barcodes_96": TrimSpec(Side(notation.adapters(barcodes(), max_errors=1, indels=False)), demultiplex="name"),
    }


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    with tempfile.TemporaryDirectory() as tmp:
        reads_path = f"{tmp}/reads"
        made = queries.synthetic(spark, SF_DIR)
        several = made.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).withColumn("rid", F.col("rid") * COPIES + F.col("copy")).drop("copy")
        several.repartition(int(CPUS)).write.parquet(reads_path)
        n = spark.read.parquet(reads_path).count()
        long_path = f"{tmp}/long"
        long = made.orderBy("rid").limit(LONG).withColumns({c: F.repeat(c, F.lit(PIECES)) for c in ("sequence", "qualities")})
        long.repartition(int(CPUS)).write.parquet(long_path)
        every = {name: (lambda s=s: trim(spark.read.parquet(reads_path), s)) for name, s in plans().items()}
        every["native_steps_long_reads"] = lambda: trim(spark.read.parquet(long_path), plans()["native_steps"])
        try:
            from strandweave.llm import queries as llm
        except ImportError:
            llm = None
        if llm:
            every |= {name: (lambda f=f: f(spark, SF_DIR)) for name, f in llm.queries().items()}
        for name, f in every.items():
            best = None
            for _ in range(2 if name in plans() or "long" in name else 1):  # the first of two also starts workers and compiles
                began = time.time()
                f().write.format("noop").mode("overwrite").save()
                best = min(best or 1e9, time.time() - began)
            seconds[name] = round(best, 3)
    print(json.dumps({"metric": "seconds over all headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "reads": n, "reads_per_s": {k: round(n / seconds[k]) for k in plans()}, "sf": SF_DIR}))


if __name__ == "__main__":
    main()
