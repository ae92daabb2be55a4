import re

import numpy as np
from compare import same_rows

from skeinlog.llm import ngram_jaccard as J
from skeinlog.llm import graph, oracle, queries, shingles


def test_shingles():
    for t in ["A b  c d", "", " \t\n", "x", "Aé b\x0bc ÉÈ", "a b c a b c a b"]:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        n = len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) if len(w) >= 3 else bool(w)
        assert len(shingles.shingle_set(t, 3)) == n
    assert set(shingles.shingle_set("A b  c", 3)) == set(shingles.shingle_set("a B\nC", 3))
    assert len(shingles.shingle_set("q" * 3_000_000 + " b c", 3)) == 1


def random_sets(rng, n, percent):
    base = [np.unique(rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64)) for _ in range(5)]
    out = []
    for _ in range(n):
        b = base[rng.integers(5)]
        keep = b[rng.random(len(b)) > rng.uniform(0, (100 - percent) / 90)]
        out.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(1, 3)).astype(np.uint64)])))
    return out


def linked(a, b, percent):
    k = len(np.intersect1d(a, b))
    return 100 * k >= percent * (len(a) + len(b) - k)


def test_similar_sets_share_a_key_and_the_tree_loses_no_link():
    rng = np.random.default_rng(4)
    for percent in (90, 80):
        levels = J.Levels(percent)
        for _ in range(8):
            sets = random_sets(rng, 90, percent)
            keys = [set(levels.keys(s).tolist()) for s in sets]
            true, tree, split = J.Union(90), J.Union(90), J.Union(90)
            for i in range(90):
                for j in range(i):
                    if linked(sets[i], sets[j], percent):
                        assert keys[i] & keys[j]
                        true.join(i, j)
            for i, j in J.verified_links(sets, percent):
                assert linked(sets[i], sets[j], percent)
                tree.join(i, j)
            side = np.arange(90) % 2
            for part in (side == 0, side == 1, side >= 0):
                at = np.flatnonzero(part)
                for i, j in J.verified_links([sets[k] for k in at], percent, side[at] if part.all() else None):
                    split.join(int(at[i]), int(at[j]))
            roots = [true.find(i) for i in range(90)]
            assert roots == [tree.find(i) for i in range(90)] == [split.find(i) for i in range(90)]


def test_query_matches_sql(spark, data):
    same_rows(queries.op4_ngram_jaccard(spark, data), oracle.ORACLE["op4_ngram_jaccard"], data)


def test_edges_and_small_blocks(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = [text.replace("w30", f"v{k}") for k in range(12)]
    rows = [(9, None, 1), (8, "", 1), (7, " \t", 1), (6, "one two", 1), (5, "ONE two", 1), (5, "ONE two", 1), (None, text, 1)]
    rows += [(20 + k, t, 1) for k, t in enumerate(near)] + [(3, text + " more", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    for block in (J.BLOCK, 100):
        out = J.similar_documents(df, width=3, percent=80, block=block).collect()
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)
        assert (9, 0, 9) in got and (8, 0, 8) in got and (7, 0, 7) in got
        assert got.count((5, 1, 5)) == 2 and (6, 1, 5) in got
        assert all((20 + k, 58, 3) in got for k in range(12)) and (None, 58, 3) in got
    kept = J.one_of_each(df, width=3, percent=80)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 7, 8, 9]
    assert J.similar_documents(df.where("false")).count() == 0


def test_one_plan_whatever_the_filter_lets_through(spark, monkeypatch):
    texts = [f"w{n // 3} " + " ".join(f"t{n // 3}_{k}" for k in range(60)) + f" end{n % 3}" for n in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = spark.createDataFrame([(n * 7919,) for n in range(50)], "node long")
    found = J._name_filter(names)
    assert 100 < np.bitwise_count(found).sum() <= 150
    seen = []
    for bits in (26, 3):  # 8 bits let all sets through
        monkeypatch.setattr(J, "FILTER_BITS", bits)
        seen.append({r.doc_id: r.component_id for r in J.similar_documents(docs).collect()})
    assert seen[0] == seen[1] == {n: n // 3 * 3 for n in range(60)}


def test_components_against_search(spark):
    """Random graphs, paths, hubs, repeated and self links; with links of a task at a time and with all at once."""
    rng = np.random.default_rng(7)
    path = [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)]
    hub = [(500, 501 + i) for i in range(60)] + [(500, -3)]
    some = [(int(1000 + x), int(1000 + y)) for x, y in rng.integers(0, 120, (90, 2))]
    links = path + path[:9] + hub + some + [(7777, 7777), (None, 3)]
    up = {}
    for a, b in links:
        if a is not None and a != b:
            up.setdefault(a, set()).add(b)
            up.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(up):
        todo = [] if n in want else [n]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += up[x]
    table = spark.createDataFrame(links, "a long, b long").repartition(5)
    for local in (4, 50, graph.LOCAL):
        found = [tuple(r) for r in graph.components(table, local=local).collect()]
        assert len(found) == len(want) and dict(found) == want
    assert graph.components(table.limit(0)).count() == 0


def test_similar_sets_share_a_token_of_their_prefixes():
    rng = np.random.default_rng(11)
    for percent in (90, 80):
        for _ in range(8):
            sets = random_sets(rng, 90, percent)
            sizes = np.array([len(s) for s in sets])
            names = np.arange(90).astype(np.uint64)
            key, node = np.concatenate(sets), np.repeat(names, sizes)
            token, of, level = J.shared_tokens(np.concatenate([key, key[:50]]), np.concatenate([node, node[:50]]))
            found, count = np.unique(key, return_counts=True)
            assert sorted(zip(token.tolist(), of.tolist())) == sorted((k, n) for k, n in zip(key.tolist(), node.tolist()) if count[np.searchsorted(found, k)] > 1)
            assert (level == np.floor(np.log2(count[np.searchsorted(found, token)]))).all()
            at = J.rarest(of, level, token, names, sizes, percent)
            prefix = [set(token[at][of[at] == n].tolist()) for n in names]
            assert all(len(p) <= n - -(-n * percent // 100) + 1 for p, n in zip(prefix, sizes.tolist(), strict=True))
            for i in range(90):
                for j in range(i):
                    assert prefix[i] & prefix[j] or not linked(sets[i], sets[j], percent)


def test_shared_passages_do_not_chain(spark, monkeypatch):
    """Each text shares passages with the texts beside it, but none is like another, save the last two."""
    passage = [" ".join(f"p{n}_{k}" for k in range(30)) for n in range(81)]
    texts = [f"{passage[n]} {' '.join(f'own{n}_{k}' for k in range(60))} {passage[n + 1]}" for n in range(80)]
    docs = spark.createDataFrame([*enumerate(texts), (80, texts[79] + " more")], "doc_id long, text string")
    clusters, staged = [], J.staged

    def seen(df, label):
        out = staged(df, label)
        if label == "clusters":
            clusters.extend(r["count"] for r in out.groupBy("root").count().collect())
        return out

    monkeypatch.setattr(J, "staged", seen)
    for parts in (J.COUNTED, 100):
        monkeypatch.setattr(J, "COUNTED", parts)
        clusters.clear()
        found = {r.doc_id: r.component_id for r in J.similar_documents(docs, width=5, percent=80).collect()}
        assert found == {n: min(n, 79) for n in range(81)}
        assert clusters == [2]
