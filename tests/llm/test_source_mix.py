"""Operator 12: targets, draws, permutations, text, against direct forms."""
import collections
import math

SCHEMA = "source string, text string, doc_id bigint, g string, size int"


def rows_of(sizes):
    """sizes: source -> words per document."""
    out, k = [], 0
    for source, counts in sizes.items():
        for n in counts:
            out.append((source, " ".join(f"w{k}_{j}" for j in range(n)) if n else [None, "", " \n"][k % 3],
                        k, "clash", -1))
            k += 1
    return out


def targets(sizes, share=1.5):
    """The stated rule: share by weight, stop at twice the size, share again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(sizes[s]) for s in names}
    target, open_ = {}, set(names)
    left = share * sum(total.values())
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w >= 2 * total[s]}
        if not over:
            target.update({s: left * weight[s] / w for s in open_})
            break
        for s in over:
            target[s] = 2.0 * total[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


SIZES = {"b": [40, 0, 300, 7], "a": [5] * 30, None: [900], "é": [3, 0], "z": [0, 0], "big": [50] * 60,
         "A": [11]}


def mixed(spark, rows, **options):
    from fernrec.llm.source_mix import mix_sources
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs, mix_sources(docs, **{"block_words": 16, "shard_slots": 8, **options})


def test_targets_and_taken(spark):
    from fernrec.llm.source_mix import taken_words
    rows = rows_of(SIZES)
    _, mix = mixed(spark, rows)
    got = {r.doc_id: r for r in taken_words(mix).collect()}
    want = targets(SIZES)
    assert len(got) == len(rows)
    taken = collections.Counter()
    for source, text, k, _, _ in rows:
        r, size = got[k], len((text or "").split())
        assert (r.size, r.source_size) == (size, sum(SIZES[source]))
        assert math.isclose(r.target, want[source], rel_tol=1e-12)
        assert 0 <= r.taken <= 2 * size
        taken[source] += r.taken
    for source in SIZES:
        assert abs(taken[source] - want[source]) <= 0.5


def test_slots_blocks_and_text(spark):
    """Every slot holds one block; a block is used again only when all were;
    the text is the block's words in order."""
    from fernrec.llm.source_mix import mixed_blocks
    rows = rows_of(SIZES)
    docs, mix = mixed(spark, rows)
    slots = mix.slots.collect()
    assert sorted(s.slot for s in slots) == list(range(len(slots)))
    assert all(s.shard == s.slot // 8 for s in slots)
    streams = {}
    for source, text, k, _, _ in rows:
        streams.setdefault("t" if source is None else "s" + source, []).extend((text or "").split())
    uses = collections.Counter((s.g, s.block) for s in slots)
    for g, words in streams.items():
        counts = [uses[g, b] for b in range(-(-len(words) // 16))]
        assert not counts or max(counts) <= 2 and max(counts) - min(counts) <= 1
    text = {(r.shard, r.slot): (r.n_words, r.text) for r in mixed_blocks(docs, mix).collect()}
    for s in slots:
        words = streams[s.g][16 * s.block:16 * s.block + s.n]
        assert text[s.shard, s.slot] == (len(words), " ".join(words)) and len(words) == s.n


def test_draws_look_multinomial(spark):
    """Counts per shard vary as draws do, around the sources' shares."""
    _, mix = mixed(spark, rows_of({"a": [400] * 10, "b": [400] * 10, "c": [400] * 10}), shard_slots=64)
    counts = collections.Counter((s.shard, s.g) for s in mix.slots.collect())
    full = [counts[k, "sa"] for k in range(17)]
    share = sum(counts[k] for k in counts if k[1] == "sa") / sum(counts.values())
    spread = sum((x - 64 * share) ** 2 for x in full) / len(full)
    assert 0.3 < spread / (64 * share * (1 - share)) < 2.5


def test_reruns_agree_whatever_the_partitions(spark):
    from fernrec.llm.source_mix import mix_sources, taken_words
    rows = rows_of(SIZES) + [("a", "one two three", 3, "x", 0)] * 3 + [("q", "u v", None, "x", 0)] * 2
    results = []
    for n in (1, 5):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(n)
        results.append(sorted(map(str, taken_words(mix_sources(docs, block_words=16)).collect())))
    assert results[0] == results[1] and len(results[0]) == len(rows)


def test_hot_source_and_empty_tables(spark):
    from fernrec.llm.source_mix import taken_words
    sizes = {f"s{k:04d}": [3] for k in range(1200)} | {"hot": [4] * 600}
    _, mix = mixed(spark, rows_of(sizes))
    got = taken_words(mix).collect()
    want = targets(sizes)
    assert len(got) == 1800
    assert abs(sum(r.taken for r in got if r.source_size == 2400) - want["hot"]) <= 0.5
    for rows in ([], rows_of({"a": [0, 0]})):
        _, mix = mixed(spark, rows)
        assert [r.taken for r in taken_words(mix).collect()] == [0] * len(rows)


def test_main_path_is_native(spark):
    from fernrec.llm.source_mix import taken_words
    _, mix = mixed(spark, rows_of({"a": [40], "b": [9]}))
    plan = taken_words(mix)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Arrow" not in plan
