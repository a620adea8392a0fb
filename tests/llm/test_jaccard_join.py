import random
import re

from feedlake.llm import jaccard_join as J
from feedlake.llm.registry import op8_jaccard_join


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        met = {}
        for w in s:
            for j in holders.setdefault(w, []):
                met[j] = met.get(j, 0) + 1
            holders[w].append(i)
        for j, both in met.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    key = lambda d: float("inf") if d is None else d
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), float("inf")), key(d))
    return sorted(((d, len(s), None if least[find(i)] == float("inf") else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def families(seed, n):
    """Copies of a few bases with more and more edits, on and around the similarity, and common passages."""
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    passage = rnd.choices(words, k=60)
    rows = []
    for base in range(6):
        text = rnd.choices(words, k=rnd.randint(20, 120))
        for k in range(n):
            copy = list(text)
            for _ in range(rnd.randint(0, max(1, len(copy) // 18))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append(" ".join(copy).title() if k % 5 == 0 else "\t".join(copy))
    for k in range(n):
        rows.append(" ".join(passage + rnd.choices(words, k=rnd.randint(0, 20))))
        rows.append(" ".join(passage[k % 50 :]))
    return rows


def test_families_against_brute_force(spark):
    for seed in (1, 2):
        texts = families(seed, 40)
        random.Random(seed).shuffle(texts)
        rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id bigint, text string, node int, n string")
        assert result(J.jaccard_groups(df, block_bytes=9000 if seed == 1 else 3 << 20)) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one\x0btwo"), (6, "one two three"), (None, "a b c d e"), (None, "A B C D E"), (8, "a b c d e"),
        (9, "é à ü ö ß"), (9, "é à ü ö ß"), (10, "word " * 30_000), (11, "word " * 9), (12, "É à ü ö ß"), (13, " ".join(map(str, range(60_000)))), (14, " ".join(map(str, range(59_000)))),
    ]
    assert result(J.jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)


def test_empty_table(spark):
    assert J.jaccard_groups(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(op8_jaccard_join(spark, sf)) == brute(rows)
