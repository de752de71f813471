import random

from tests.llm.fixtures import awkward_texts, documents, with_clashes, words
from tessera.llm import neardup
from tessera.llm.components import least_members
from tessera.llm.neardup import drop_near_duplicates, near_duplicates


def brute(texts):
    sets = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return [(i, len(s), top(i), top(i) == i) for i, s in enumerate(sets)]


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def family(seed, n=60, size=120):
    """A base text with edited copies, of which many are alike only to the base or to one another."""
    rng = random.Random(seed)
    base = words(rng, size).split()
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = words(rng, 1)
        out.append(" ".join(w))
    rng.shuffle(out)
    return out


def test_equals_brute_force(spark):
    texts = awkward_texts() + family(1) + family(2)
    docs = with_clashes(documents(spark, texts), "n_shingles", "component", "key", "id", "kept")
    assert rows(near_duplicates(docs)) == brute(texts)


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    texts = family(3) + awkward_texts()
    assert rows(near_duplicates(documents(spark, texts))) == brute(texts)


def test_one_of_each_group_stays(spark):
    texts = awkward_texts()
    docs = documents(spark, texts)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in brute(texts) if r[3]]


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).count() == 0


def test_chain_of_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in least_members(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_repeated_and_null_ids_keep_their_links(spark):
    rng = random.Random(9)
    a, b, c = (words(rng, 80) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, c), (None, c + " more"), (None, None), (5, c), (1, a), (None, words(rng, 30)), (7, ""), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs)
    by_text = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in got.collect()}
    assert by_text[1, 76] == (1, True) and by_text[2, 77] == (1, False) and by_text[3, 77] == (1, False)
    assert by_text[5, 76] == (5, True) and by_text[None, 76] == (5, False) and by_text[None, 77] == (5, False)
    assert by_text[None, 26] == (None, True) and by_text[None, 0] == (None, True)
    assert got.count() == len(rows)
    kept = sorted((tuple(r) for r in drop_near_duplicates(docs).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (None, None), (5, c), (None, rows[9][1]), (7, ""), (7, "")], key=str)


def test_identical_rows_leave_one(spark):
    text = words(random.Random(4), 50)
    docs = with_clashes(spark.createDataFrame([(4, text)] * 3 + [(None, text + " x")] * 2, "doc_id long, text string"), "row", "least")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert [(r.doc_id, r.text) for r in kept.collect()] == [(4, text)]


def test_blocks_are_compared_once(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 60 - i % 7] + [f"x{i}"] * (i % 5))) for i in range(40)]
    plans = []

    def recorded(links):
        plans.append(links._jdf.queryExecution().optimizedPlan().toString())
        return least_members(links)

    monkeypatch.setattr(neardup, "least_members", recorded)
    neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(plans) == 2 and not any(word in plan for plan in plans for word in ("FlatMapGroupsInArrow", "Join", "Aggregate"))
