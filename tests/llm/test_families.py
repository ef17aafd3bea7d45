"""Near-duplicates within families of documents that share a template."""

import random

from lithoframe.llm import simhash


def test_pairs_in_template_families_are_found(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.getrandbits(60)}" for _ in range(n)]
    rows, family, doc = [], 100, 0
    for _ in range(2):
        template = words(175)  # 171 of a document's 200 shingles: two documents are at 0.747
        for _ in range(family // 2):
            shared = words(8)  # a planted pair is at 0.81
            for _ in range(2):
                rows.append((doc, " ".join(template + shared + words(21))))
                doc += 1
    hashes = [set(simhash.shingle_hashes(t, 5, 42).tolist()) for _, t in rows]
    likeness = lambda i, j: len(hashes[i] & hashes[j]) / len(hashes[i] | hashes[j])
    assert likeness(0, 1) >= 0.8 > likeness(0, 2)
    out = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] in (i, i - i % 2) for i in out)  # nothing else is joined
    found = sum(out[i] == i - 1 for i in out if i % 2)
    print("pairs found:", found, "of", family)
    assert found >= 94


def test_different_texts_under_one_id_stay(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.getrandbits(40)}" for _ in range(n))
    a, b, c = words(80), words(80), words(80)
    rows = [(5, a, 1), (5, b, 2), (6, c, 3), (7, b + " more", 4), (7, a, 5), (8, c, 6), (8, c, 6), (9, a, 7), (None, a, 8), (None, None, 9)]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, k int"), measure="cosine", recall=0.9)
    assert sorted((r.doc_id or 0, r.k) for r in out.collect()) == [(0, 8), (0, 9), (5, 1), (5, 2), (6, 3)]
    twice = spark.createDataFrame([(1, a, 1), (1, a, 2), (2, b, 3), (2, b, 3)], "doc_id long, text string, k int")
    assert [r.doc_id for r in simhash.keep_one(twice).orderBy("doc_id").collect()] == [1, 2]


def test_groups_by_cosine_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 400))]
        for _ in range(rng.choice([1, 2, 4, 30])):
            w = list(base)
            for _ in range(int(len(w) * rng.random() * 0.06)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    sets = [set(simhash.shingle_hashes(t, 5, 42).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) ** 2 * 100 >= 64 * len(sets[i]) * len(sets[j])]
    for i, j in links:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), measure="cosine", recall=0.9).collect()}
    assert all(find(i) == find(got[i]) for i in got)  # nothing is joined that links don't join
    assert sum(got[i] == got[j] for i, j in links) >= 0.97 * len(links) > 1000
