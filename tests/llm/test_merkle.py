import hashlib
import random

import pytest
from helpers import rows

from adlake.llm import merkle
from adlake.llm.queries import op13_merkle_manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes, arity=16):
    """Root of ``nodes`` and, for each, its (place, siblings) level by level: plainly, all at once."""
    where, trails = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, at in enumerate(where):
            run = nodes[at // arity * arity:at // arity * arity + arity]
            trails[i].append((at % arity, run[:at % arity] + run[at % arity + 1:]))
        nodes = [H(*nodes[i:i + arity]) for i in range(0, len(nodes), arity)]
        where = [at // arity for at in where]
    return nodes[0], trails


def plain_leaf(r, text):
    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*[part(r[c]) for c in ("doc_id", "source", "lang", "n_chars")], part(text))


def plain(data):
    groups = {}
    for r in data:
        groups.setdefault((r["source"] is not None, (r["source"] or "").encode()), []).append((r["id"], r["leaf"]))
    names = sorted(groups)
    trees = {}
    for name in names:
        trees[name] = (leaves := sorted(groups[name], key=lambda x: (x[0] is not None, x[0] or 0, x[1])),
                       *climb([leaf for _, leaf in leaves]))
    root, tops = climb([trees[n][1] for n in names])
    out = []
    for name, top in zip(names, tops):
        leaves, subroot, trails = trees[name]
        for (i, leaf), trail in zip(leaves, trails):
            out.append((i, leaf, subroot, root, [*trail, *top]))
    return out


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 513])
def test_appends_give_the_root_and_witness_of_the_whole(n):
    leaves = [H(str(i)) for i in range(n)]
    tree, got = merkle.Witnesses(), [[] for _ in leaves]
    for leaf, witness in zip(leaves, got):
        tree.append(leaf, witness)
    root, trails = climb(leaves)
    assert tree.root() == root and got == trails
    assert all(merkle.folded(leaf, w) == root for leaf, w in zip(leaves, got))


def test_aligned_append_of_whole_subtrees():
    leaves = [H(str(i)) for i in range(70)]
    tree = merkle.Witnesses(4)
    for at in range(0, 64, 16):
        block = merkle.Witnesses(4)
        for leaf in leaves[at:at + 16]:
            block.append(leaf)
        tree.append(block.root(), level=2)
    for leaf in leaves[64:]:
        tree.append(leaf)
    with pytest.raises(ValueError):
        tree.append(H("x"), level=1)
    assert tree.root() == climb(leaves, 4)[0]


def frame(spark, data):
    return spark.createDataFrame([(r["id"], r["source"], r["leaf"]) for r in data], "id long, `group` string, digest string")


def outcome(made):
    return sorted((str(r["id"]), r["digest"], r["subroot"], r["root"],
                   str([(s["place"], s["siblings"]) for s in r["steps"]])) for r in rows(made.witnesses("id long")))


def expected(data):
    return sorted((str(i), leaf, sub, root, str(trail)) for i, leaf, sub, root, trail in plain(data))


@pytest.mark.parametrize(("arity", "height"), [(16, 2), (2, 3), (3, 1)])
def test_witnesses_of_many_groups(spark, arity, height, monkeypatch):
    rng = random.Random(arity)
    data = [{"id": i, "source": rng.choice(["hot", "hot", "hot", None, "", "é", "z", "Z", f"s{i % 40}"]), "leaf": H(str(i))}
            for i in range(900)]
    if arity != 16:
        monkeypatch.setitem(climb.__kwdefaults__ or {}, "arity", arity)
        monkeypatch.setattr(climb, "__defaults__", (arity,))
    made = merkle.manifest(frame(spark, data).repartition(5), arity, height)
    assert outcome(made) == expected(data)


def test_nulls_ties_repeats_and_lone_leaves(spark):
    data = [{"id": None, "source": None, "leaf": H("a")}, {"id": None, "source": None, "leaf": H("a")},
            {"id": 3, "source": "a", "leaf": H("b")}, {"id": 3, "source": "a", "leaf": H("c")}]
    assert outcome(merkle.manifest(frame(spark, data))) == expected(data)
    lone = [{"id": 1, "source": s, "leaf": H(str(s))} for s in ("a", "b", None)]
    assert outcome(merkle.manifest(frame(spark, lone))) == expected(lone)
    assert outcome(merkle.manifest(frame(spark, lone[:1]))) == expected(lone[:1])
    assert outcome(merkle.manifest(frame(spark, lone).limit(0))) == []


def test_growth_in_steps_equals_the_whole(spark):
    rng = random.Random(7)
    data = [{"id": i, "source": rng.choice(["a", "a", "a", "b", None, f"late{i // 300}"]), "leaf": H(str(i))} for i in range(1300)]
    made = merkle.manifest(frame(spark, data[:200]))
    for a, b in ((200, 201), (201, 700), (700, 1300)):
        made = merkle.grown(made, frame(spark, data[a:b]))
        assert outcome(made) == expected(data[:b])
    with pytest.raises(ValueError):
        merkle.grown(made, frame(spark, [{"id": 5, "source": "a", "leaf": H("x")}]))


def test_closed_blocks_are_not_hashed_again(spark, monkeypatch):
    data = [{"id": i, "source": "a", "leaf": H(str(i))} for i in range(600)]
    made = merkle.manifest(frame(spark, data))
    seen, real = [], merkle.block_roots

    def watched(nodes, *more):
        seen.append(nodes.count())
        return real(nodes, *more)

    monkeypatch.setattr(merkle, "block_roots", watched)
    more = merkle.grown(made, frame(spark, [{"id": 600 + i, "source": "a", "leaf": H(str(600 + i))} for i in range(10)]))
    assert seen[0] == 98  # 88 leaves of the open block and 10 new ones, of 610
    assert {r["root"] for r in rows(more.witnesses("id long"))} == {climb([H(str(i)) for i in range(610)])[0]}


def test_query_on_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, place string, digest string, `group` string"
    odd = [(None, None, None, None, None, "p", "d", "g"), (5, "AÉ é" * 30000, "en", "a", 4, "", "", ""), (0, "", "", "", 0, "", "", ""),
           (0, "", "", "", 0, "", "", "")]
    odd += [(i, f"Text {i}", "de", "a", i, None, None, None) for i in range(10, 60)]
    spark.createDataFrame(odd, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(op13_merkle_manifest(spark, str(tmp_path)))
    names = schema.replace("`", "").replace(" string", "").replace(" long", "").split(", ")
    docs = [dict(zip(names, r)) for r in odd]
    want = plain([{"id": d["doc_id"], "source": d["source"], "leaf": plain_leaf(d, d["text"])} for d in docs])
    assert sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == sorted(
        (str(i), leaf, sub, root, H(*[s for _, run in trail for s in run])) for i, leaf, sub, root, trail in want)
    import zlib
    for r in got:
        text = next(d["text"] for d in docs if d["doc_id"] == r["doc_id"])
        tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        changed = tampered and text and any("A" <= c <= "Z" for c in text)
        assert r["verified"] == (r["folded_root"] == r["root"]) == (not changed)
    empty = tmp_path / "none"
    spark.createDataFrame([], schema).write.parquet(str(empty / "documents.parquet"))
    assert rows(op13_merkle_manifest(spark, str(empty))) == []
