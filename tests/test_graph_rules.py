"""Rules over many small graphs at once against the same rules in plain Python; chunks of samples likewise."""

import random

from tessera.operators import graph, sequence


def reach(edges, start):
    found, new = set(start), list(start)
    while new:
        at = new.pop()
        for a, b in edges:
            if a == at and b not in found:
                found.add(b)
                new.append(b)
    return found


def brute_removal(items, built, seeds, told):
    nodes = set(items)
    built = [e for e in built if set(e) <= nodes]
    told = [e for e in told if set(e) <= nodes]
    seeds &= nodes
    candidates = reach(built, seeds)
    needed = reach(built, nodes - candidates)
    gone = candidates - needed
    loose = {o for o, _ in told if all(t in gone for a, t in told if a == o)}
    bad = any(items[n][0] for n in candidates) or seeds & needed or any(not items[n][1] for n in loose - gone)
    return {n: "refused" if bad else "removed" if n in gone | loose else "kept" for n in nodes}


def test_stratified_removal(spark):
    draw, items, built, seeds, told, want = random.Random(1), [], [], [], [], []
    for g in range(150):
        n = draw.randint(1, 7)
        own = {k: (k == 0 and draw.random() < 0.9, draw.random() < 0.7) for k in range(n)}
        pairs = lambda m: [(draw.randint(0, n), draw.randint(0, n)) for _ in range(draw.randint(0, m))]  # noqa: B023, E731  a number that no item has is a loose end
        one, two, gone = pairs(6), pairs(3), {draw.randint(0, n) for _ in range(draw.randint(0, 2))}
        key = None if g == 3 else g
        items += [(key, k, *f) for k, f in own.items()] + [(key, 0, *own[0])]
        built += [(key, *e) for e in one]
        told += [(key, *e) for e in two]
        seeds += [(key, s) for s in gone]
        if key is not None:  # null keys equal nothing: such groups are told apart by the caller
            want += [(key, k, f) for k, f in brute_removal(own, one, gone, two).items()]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    edges = "g int, origin int, target int"
    got = graph.stratified_removal(frame(items, "g int, node int, is_primary boolean, may_describe boolean"), frame(built, edges), frame(seeds, "g int, node int"), frame(told, edges), ("g",))
    rows = sorted((r.g, r.node, r.fate) for r in got.collect() if r.g is not None)
    assert rows == sorted(want) and {r[2] for r in rows} == {"kept", "removed", "refused"}


def test_closure_by_group_and_long_chains(spark):
    edges = [(g, k, k + 1) for g in (1, 2) for k in range(40)] + [(1, 40, 0), (3, 0, 1)]
    got = graph.closure(spark.createDataFrame(edges, "g int, origin int, target int"), spark.createDataFrame([(1, 38), (2, 38)], "g int, node int"), keys=("g",))
    assert sorted(map(tuple, got.collect())) == [(1, k) for k in range(41)] + [(2, k) for k in (38, 39, 40)]


def brute_tracks(tracks, refs, removable, kept, dangling):
    chapters = {t for _, k, t in refs if k == "chap"}
    others = {t for _, k, t in refs if k != "chap"}
    gone = {n for n, (kind, on) in tracks.items() if kind in removable or n in chapters and (kind == "text" or kind == "vide" and not on and n not in others)}
    by = {}
    for o, k, t in refs:
        by.setdefault((o, k), set()).add(t)
    gone |= {o for (o, k), ts in by.items() if k == "thmb" and o in tracks and ts <= set(tracks) - gone - {o}}
    reasons = [0 for n, (kind, _) in tracks.items() if n not in gone and kind not in kept]
    for (o, k), ts in by.items():
        if o in gone:
            reasons += [1] * (k == "rndr" and bool(ts - gone))
        elif o in tracks and ts & gone and not (k in dangling and ts <= gone):
            reasons.append(2)
    return gone, ("kind", "needed", "depends")[min(reasons)] if reasons else None


def test_selected_tracks(spark):
    draw, tracks, refs, want = random.Random(2), [], [], []
    for g in range(200):
        own = {k: (draw.choice(["vide", "soun", "text", "meta", "vide"]), draw.random() < 0.6) for k in range(1, draw.randint(2, 6))}
        told = {(draw.choice(list(own)), draw.choice(["chap", "thmb", "rndr", "cdsc"]), draw.randint(1, len(own) + (g % 9 == 0))) for _ in range(draw.randint(0, 4))}
        tracks += [(g, k, *v) for k, v in own.items()]
        refs += [(g, *r) for r in told]
        gone, reason = brute_tracks(own, told, ["meta"], ["vide", "soun", "text"] if g % 2 else ["vide", "soun"], ["chap", "cdsc"])
        want += [(g, k, "removed" if k in gone else "kept", reason) for k in own]
    frames = [spark.createDataFrame(tracks, "g int, node int, kind string, enabled boolean"), spark.createDataFrame(refs, "g int, origin int, kind string, target int")]
    for odd, kept in ((1, ["vide", "soun", "text"]), (0, ["vide", "soun"])):
        one, two = (f.filter(f"g % 2 = {odd}") for f in frames)
        got = graph.selected_tracks(one, two, ("g",), ["meta"], kept, ["chap", "cdsc"])
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(w) for w in want if w[0] % 2 == odd)
    assert {w[3] for w in want} == {None, "kind", "needed", "depends"}


def test_chunk_spans(spark):
    draw, chunks, runs, samples, want = random.Random(3), [], [], [], []
    for k in range(40):
        sizes = [draw.choice([0, 3, 10]) for _ in range(draw.randint(0, 30))]
        rules = sorted(draw.sample(range(1, 9), draw.randint(0, 3)))
        counts = {r: draw.randint(0, 4) for r in rules}
        at = 0
        for c in range(1, 9):
            n = next((counts[r] for r in reversed(rules) if r <= c), 0)
            chunks.append((k, c, 1000 * c))
            want.append((k, c, at, n, 1000 * c + sum(sizes[at : at + n]), at + n <= len(sizes)))
            at += n
        runs += [(k, r, n) for r, n in counts.items()]
        samples += [(k, n, s) for n, s in enumerate(sizes)]
    frames = [spark.createDataFrame(chunks, "k int, chunk int, at long"), spark.createDataFrame(runs, "k int, first int, per_chunk int"), spark.createDataFrame(samples, "k int, n int, size int")]
    for slice_rows in (None, 5):
        got = sequence.chunk_spans(*frames, ["k"], slice_rows)
        assert sorted(tuple(r) for r in got.select("k", "chunk", "first_sample", "n_samples", "end", "complete").collect()) == sorted(want)


def test_levels_read_stored_references(spark):
    """References that are costly to make are made once, however many levels and rules read them."""
    made = spark.sparkContext.accumulator(0)

    def once(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    chain = 6
    items = spark.createDataFrame([(0, n, n == 0, True) for n in range(chain + 1)], "k int, node int, is_primary boolean, may_describe boolean")
    built = spark.createDataFrame([(0, n, n + 1) for n in range(1, chain)], "k int, origin int, target int").mapInArrow(once, "k int, origin int, target int")
    none = spark.createDataFrame([], "k int, origin int, target int")
    got = graph.stratified_removal(items, built, spark.createDataFrame([(0, 1)], "k int, node int"), none, ("k",)).collect()
    assert sorted((r.node, r.fate) for r in got) == [(0, "kept"), *((n, "removed") for n in range(1, chain + 1))]
    assert made.value == chain - 1


def test_rules_of_tracks_read_stored_references(spark):
    made = spark.sparkContext.accumulator(0)

    def once(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    tracks = spark.createDataFrame([(0, 1, "vide", True), (0, 2, "text", True), (0, 3, "vide", True)], "k int, node int, kind string, enabled boolean")
    schema = "k int, origin int, kind string, target int"
    refs = spark.createDataFrame([(0, 1, "chap", 2), (0, 3, "thmb", 1)], schema).mapInArrow(once, schema)
    got = graph.selected_tracks(tracks, refs, ("k",), ["meta"], ["vide", "soun"], ["chap"]).collect()
    assert sorted(map(tuple, got)) == [(0, 1, "kept", None), (0, 2, "removed", None), (0, 3, "removed", None)] and made.value == 2
