"""Operator 13 against plain trees; the log's places; tampering."""
import hashlib
import zlib

SCHEMA = "extra int, text string, n_chars bigint, lang string, source string, doc_id bigint, tree string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}"
                 for v in (doc_id, source, lang, n_chars, text)])


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[k:k + 16]) for k in range(0, len(last), 16)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // 16 * 16:i // 16 * 16 + 16]
        out.append((i % 16, run))
        i //= 16
    return out


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted result rows."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = {}, {}
    for s in sources:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(*r), r) for r in rows if r[1] == s),
                     key=lambda x: x[:3])
        members[s] = own
        trees[s] = tree([x[2] for x in own])
    top = tree([trees[s][-1][0] for s in sources]) if sources else []
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, digest, r) in enumerate(members[s]):
            steps = path(trees[s], i) + path(top, k)
            others = "".join(x for at, run in steps for j, x in enumerate(run) if j != at)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(*r[:4], r[4].translate(low)) if bad and r[4] is not None else digest
            for at, run in steps:
                node = sha(*run[:at], node, *run[at + 1:])
            out.append((r[0], digest, trees[s][-1][0], top[-1][0], sha(others), node,
                        node == top[-1][0]))
    return sorted(out, key=str), trees


def frame(spark, rows):
    return spark.createDataFrame([(1, t, n, l, s, d, "x") for d, s, l, n, t in rows], SCHEMA)


def sample():
    rows = []
    for k, (source, n) in enumerate({None: 3, "a": 1, "b": 16, "c": 17, "é": 300, "hot": 4400,
                                     "Z": 257}.items()):
        for j in range(n):
            rows.append((10_000 * k + (7 * j) % n, source, "en" if j % 3 else None,
                         j if j % 5 else None, [f"Text {j} Ä", None, "", "lower"][j % 4]))
    return rows + [(rows[0])] * 2 + [(None, "b", "en", 4, "No id"), (40_001, "é", "fr", 1, "Same id")]


def test_against_plain_trees(spark):
    from fernrec.llm.merkle_manifest import merkle_proofs
    rows = sample()
    want, _ = brute(rows)
    for levels in (2, 1):
        got = sorted((tuple(r) for r in merkle_proofs(frame(spark, rows).repartition(5), levels)
                      .collect()), key=str)
        assert got == want
    assert {r[-1] for r in want} == {True, False}


def test_many_sources_and_empty_table(spark):
    from fernrec.llm.merkle_manifest import merkle_proofs
    rows = [(k, f"s{k % 300}", "en", k, f"T {k}") for k in range(500)]
    got = sorted((tuple(r) for r in merkle_proofs(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)[0]
    assert merkle_proofs(frame(spark, [])).collect() == []
    one = merkle_proofs(frame(spark, rows[:1])).collect()
    assert [tuple(r) for r in one] == brute(rows[:1])[0] and one[0].root == one[0].leaf


def test_log_is_in_completion_order(spark):
    """The segments' nodes fill the places of one postorder log per source, as
    appending the leaves one by one to an unbounded tree would."""
    from fernrec.llm.merkle_manifest import Manifest, append_log, height
    rows = sample()
    _, trees = brute(rows)
    logs = {}
    for r in Manifest(frame(spark, rows)).log_nodes().collect():
        logs.setdefault(r.tree, {})[r.place] = r.digest
    assert len(logs) == len(trees)
    for source, levels in trees.items():
        log = logs["" if source is None else "s" + source]
        want = append_log(levels[0], height(len(levels[0])))
        assert [log[k] for k in range(len(log))] == want
        assert len(want) == sum(map(len, levels))


def test_places_follow_from_subtree_sizes():
    from fernrec.llm.merkle_manifest import append_log, fold, height, log_place, siblings
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 4096, 4113):
        leaves = [sha(str(k)) for k in range(n)]
        levels = tree(leaves)
        log = append_log(leaves, height(n))
        assert len(levels) == height(n) + 1 and log[-1] == levels[-1][0]
        for level, nodes in enumerate(levels):
            assert [log[log_place(level, k, n)] for k in range(len(nodes))] == nodes
        for k in {0, n // 2, n - 1}:
            assert fold(leaves[k], siblings(log, n, height(n), k)) == log[-1]
