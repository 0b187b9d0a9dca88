"""What a Python worker still holds when a task of a corpus operator is over."""

import random
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

REPO = Path(__file__).parents[2]
#: With one core there is one worker, which Spark keeps for the next task.
RUN = r"""
import re, sys
from pathlib import Path
from pyspark.sql import SparkSession
import pyarrow as pa
from pricewright.llm import minhash, packing
from pricewright.shipping import ship_package

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
ship_package(spark)  # workers before and after it are not the same
docs = spark.read.parquet(sys.argv[1]).coalesce(1)
made = {"sketch": lambda: minhash.sketched(docs, "doc_id", "text", 2), "pack": lambda: packing.pieces(docs)}[sys.argv[2]]

def look(batches):
    import os
    from pricewright.llm import packing
    for batch in batches:
        held = sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())))
        words = sum(len(e.words) for e in packing._ENCODERS.values())
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "mb": [held // 1024], "words": [words]})

def seen():
    return spark.range(1, numPartitions=1).mapInArrow(look, "pid long, mb long, words long").collect()[0]  # first() would end the worker

first = seen()
made().write.format("noop").mode("overwrite").save()
last = seen()
print("HELD", first.pid == last.pid, last.mb - first.mb, last.words)
"""


@pytest.mark.parametrize(("name", "most_mb"), [("sketch", 50), ("pack", 110)])
def test_a_worker_hands_back_what_a_task_held(tmp_path, name, most_mb):
    draw = random.Random(1)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(4, 10))) for _ in range(250_000)]
    texts = [" ".join(draw.choices(words, k=400)) for _ in range(8000)]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts}), tmp_path / "documents.parquet")
    out = subprocess.run([sys.executable, "-c", RUN, str(tmp_path / "documents.parquet"), name], cwd=REPO, capture_output=True, text=True, timeout=300)
    said = [x.split() for x in out.stdout.splitlines() if x.startswith("HELD")]
    assert said, out.stderr[-2000:]
    _, same, mb, remembered = said[0]
    assert same == "True" and int(mb) < most_mb and remembered == "0", said
