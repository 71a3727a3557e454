"""The Merkle manifest against a plain tree over one list."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import merkle
from ledgerlens.llm.queries import QUERIES

from .conftest import DOCS, edge_rows


def h(x: str) -> str:
    return sha256(x.encode()).hexdigest()


def net(*values) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def level_up(nodes):
    return [h("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]


def reduce(nodes):
    while len(nodes) > 1:
        nodes = level_up(nodes)
    return nodes[0]


def others(nodes, at):
    out = []
    while len(nodes) > 1:
        out.append("".join(nodes[k] for k in range(at - at % 2, min(at - at % 2 + 2, len(nodes))) if k != at))
        nodes, at = level_up(nodes), at // 2
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded root): whole trees are built anew for every version."""
    groups = {}
    for doc_id, text, lang, source, n in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n is not None
        leaf, changed = net(doc_id, source, lang, n, text), net(doc_id, source, lang, n + 1, text) if hit else None
        groups.setdefault(lang, []).append((doc_id, leaf, changed))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subs = [reduce([x[1] for x in groups[g]]) for g in order]
    out = []
    for k, g in enumerate(order):
        leaves = [x[1] for x in groups[g]]
        for at, (doc_id, leaf, changed) in enumerate(groups[g]):
            proof = h("".join(others(leaves, at) + others(subs, k)))
            root = reduce(subs)
            folded = root
            if changed:
                folded = reduce([*subs[:k], reduce([*leaves[:at], changed, *leaves[at + 1 :]]), *subs[k + 1 :]])
            out.append((doc_id, leaf, subs[k], root, proof, folded, folded == root))
    return out


def run(df):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(df, hit).withColumn("proof_sha256", merkle.proof_digest())


def key(x):
    return tuple(map(str, x))


def check(df, rows):
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in run(df).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_edges_and_clashing_names(spark, edges, clashing, no_docs):
    check(edges, edge_rows())
    check(clashing.withColumn("pos", F.lit("own")).withColumn("grp", F.lit("own")), edge_rows())
    assert run(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 255, 256, 257, 513, 1025])
def test_sizes_around_the_blocks(spark, n):
    rows = [(i * 3, f"t{i % 5}", "en", None, i % 4) for i in range(n)] + [(1, "x", "de", "s", None)] * (n % 3)
    check(spark.createDataFrame(rows, DOCS), rows)


def test_more_than_one_round_of_blocks(spark):
    rows = [(i, "", None if i % 3 else "a", "s", i) for i in range(70_000 // 1000 * 1000)]
    df = spark.range(len(rows)).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.when(F.col("id") % 3 == 0, "a").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    got = run(df).select("doc_id", "leaf", "root", "subroot", "folded_root", "verified", "tampered", F.size("copies").alias("copied"), F.size("path").alias("steps"))
    some = {r.doc_id: r for r in got.where("doc_id < 40 or doc_id >= 69990").collect()}
    leaves = {g: [net(r[0], r[3], r[2], r[4], r[1]) for r in rows if r[2] == g] for g in (None, "a")}
    subs = [reduce(leaves[None]), reduce(leaves["a"])]
    assert all(r.root == h("".join(subs)) for r in some.values())
    assert all(r.verified is not r.tampered for r in some.values())
    hit = next(r for r in some.values() if r.tampered and r.doc_id % 3)
    at = [r[0] for r in rows if r[2] is None].index(hit.doc_id)
    changed = net(hit.doc_id, "s", None, hit.doc_id + 1, "")
    assert hit.folded_root == h(reduce([*leaves[None][:at], changed, *leaves[None][at + 1 :]]) + subs[1])
    # a version copies its ancestors and nothing else
    assert hit.copied == hit.steps == merkle.depth(len(leaves[None])) + 1


def test_a_version_shares_what_it_does_not_touch():
    tree = merkle.Tree([h(str(i)) for i in range(11)], merkle.depth(11))
    before = [list(level) for level in tree.levels]
    copies = tree.version(10, h("other"))
    assert tree.levels == before and len(copies) == 4
    assert copies[-1] == reduce([h(str(i)) for i in range(10)] + [h("other")]) != tree.top == reduce([h(str(i)) for i in range(11)])


def test_registered_query_equals_the_plain_tree(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(map(key, QUERIES["op12_merkle"](spark, folder).collect())) == sorted(map(key, plain(rows)))
