from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cordon.operators import findings
from cordon.schema import FINDING, MESSAGE
from cordon.streaming import stateful


def finding(osv, level, k):
    names = [("m", None, None), ("m", "m/p", None), ("m", "m/p", f"F{k}")][level - 1]
    return {"osv": osv, "fixed_version": f"v{k}", "trace": [{"module": names[0], "version": "v1.0.0", "package": names[1], "function": names[2], "receiver": None, "position": None}]}


def runs(spark, schema, folder, parts, query):
    """Feed the parts, and start the query anew from its checkpoint for each of them."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{folder}/in")
        with stateful.list_states(spark):
            q = query(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in"))
            q.writeStream.format("parquet").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_end_in_the_most_specific(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [finding(f"V{rng.randrange(4)}", rng.randint(1, 3) if k > 6 else 1, k) for k in range(24)]
    rng.shuffle(rows)
    changes = runs(spark, FINDING, tmp_path, [rows[:9], rows[9:15], rows[15:]], stateful.precise_changes)
    key = lambda df: sorted((r.osv, r.level, r.fixed_version, str(r.trace)) for r in df.collect())
    assert key(stateful.standing(changes)) == key(findings.most_specific(spark.createDataFrame(rows, FINDING)))
    assert changes.where("action = 'retract'").count() > 0


@pytest.mark.parametrize("seed", [3])
def test_findings_and_entries_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    found = [finding(f"V{k % 4}", 1 + k % 3, k) for k in range(16)]
    rows = [{"finding": f} for f in found] + [{"osv": {"id": f"V{k}", "summary": f"Flaw {k}"}} for k in range(3)] + [{"progress": {"message": "x"}}]
    rng.shuffle(rows)
    met = runs(spark, MESSAGE, tmp_path, [rows[:7], rows[7:12], rows[12:]], stateful.meetings)
    rest = stateful.unmet(spark, f"{tmp_path}/ck")
    got = sorted((r.osv, r.fixed_version, r.entry.id, r.entry.summary) for r in stateful.paired(met.unionByName(rest)).collect())
    assert got == sorted((f["osv"], f["fixed_version"], f["osv"], None if f["osv"] == "V3" else f"Flaw {f['osv'][1:]}") for f in found)
