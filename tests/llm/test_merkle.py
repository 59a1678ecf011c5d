import hashlib
import random
import zlib
from itertools import groupby

import pytest
from factweir.llm import entries, merkle, oracles
from pyspark.sql import functions as F

from tests.oracle import connection, same


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """The root and each leaf's steps (before, after)."""
    steps, levels = [[] for _ in leaves], [list(leaves)]
    at = list(range(len(leaves)))
    while len(levels[-1]) > 1:
        now = levels[-1]
        runs = [now[i : i + 8] for i in range(0, len(now), 8)]
        for n, i in enumerate(at):
            run, j = runs[i // 8], i % 8
            steps[n].append(("".join(run[:j]), "".join(run[j + 1 :])))
            at[n] = i // 8
        levels.append([H(*r) for r in runs])
    return levels[-1][0], steps


def brute(rows):
    """Rows of (doc_id, source, lang, n_chars, text) to what the query returns."""
    def order(r):
        return (r[0] is not None, r[0] or 0, H(*map(field, r)))

    groups = []
    for lang, members in groupby(sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), order(r))), key=lambda r: r[2]):
        members = list(members)
        groups.append((lang, members, *tree([H(*map(field, r)) for r in members])))
    if not groups:
        return []
    root, above = tree([g[2] for g in groups])
    out = []
    for (_, members, subroot, steps), top in zip(groups, above, strict=True):
        for r, own in zip(members, steps, strict=True):
            proof = own + top
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                changed = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            d = H(*map(field, changed))
            for before, after in proof:
                d = H(before, d, after)
            out.append((r[0], H(*map(field, r)), subroot, root, H(*(a + b for a, b in proof)), d, d == root))
    return sorted(out, key=repr)


def run(spark, rows, tmp_path, parts=None):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    (df.repartition(parts) if parts else df).withColumn("extra", F.lit(1)).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, entries.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [8], [9], [1, 8, 9, 64, 65, 513, 1], [2] * 11])
def test_sizes_of_groups(spark, tmp_path, sizes):
    draw = random.Random(len(sizes))
    rows = [(draw.randrange(10**6) * 7 + k, "s", f"l{g}", k, f"Text {k} É") for g, n in enumerate(sizes) for k in range(n)]
    assert run(spark, rows, tmp_path, 5) == brute(rows)


def test_awkward_rows(spark, tmp_path):
    rows = [(i % 40 if i % 9 else None, None if i % 4 else "src", (None, "", "en", "é", "ﬁ", "zz")[i % 6], None if i % 5 else i, (None, "", "Abc É", "x\x00Y", "é" * 900, "A" * 50_000)[i % 6 - i % 2]) for i in range(300)]
    rows += [rows[3]] * 20 + [rows[7]] * 9  # repeated rows are leaves of their own
    assert run(spark, rows, tmp_path, 7) == brute(rows)


def test_no_rows(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_prove_takes_any_columns_and_fan(spark):
    rows = [(i, f"g{i % 3}", i * i, "n", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(100)]
    df = spark.createDataFrame(rows, "_i long, ROOT string, _g long, proof_ string, leaf string")
    got = merkle.prove(df, group="ROOT", key="_i", fan=3).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).toPandas()
    assert len(got) == 100 and (got["folded"] == got["root"]).all() and got["subroot"].nunique() == 3
    assert sorted(got["_g"]) == sorted(r[2] for r in rows)


def test_query_and_sql(spark, data):
    same(entries.op13_merkle_manifest(spark, data), connection(data), oracles.merkle_manifest())
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, entries.op13_merkle_manifest(spark, data).collect()), key=repr) == brute(rows)
