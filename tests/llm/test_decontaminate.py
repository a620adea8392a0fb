import random
import re

from feedlake.llm import decontaminate as D
from feedlake.llm.registry import op5_decontaminate

TOKEN = re.compile(r"(?:[^\W_]|[^\x00-\x7f]|(?<=\d)[.,](?=\d))+", re.ASCII)


def tokens(text):
    """(template token, value) of every token, by plain rules."""
    out, end, number = [], None, False
    for m in TOKEN.finditer(text or ""):
        word = m[0]
        low = re.sub("[A-ZÀ-ÖØ-Þ]", lambda c: c[0].lower(), word)
        within = end is not None and not re.search(r"[.!?:;\n]", text[end : m.start()])
        if word[0] in "0123456789":
            out.append(("<number>", low))
        elif number and low in D.UNITS:
            out.append(("<unit>", low))
        elif within and re.match("[A-ZÀ-ÖØ-Þ]", word):
            out.append(("<name>", low))
        else:
            out.append((low, None))
        number, end = word[0] in "0123456789", m.end()
    return out


def windows(found, width):
    for at in range(len(found) - width + 1):
        part = found[at : at + width]
        if sum(v is None for _, v in part) >= min(D.LITERALS, width - 1):
            yield at, tuple(t for t, _ in part), [v for _, v in part if v is not None]


def brute(docs, items):
    out = set()
    for item_id, text in items:
        own = tokens(text)
        if len(own) < D.LEAST:
            continue
        width = min(D.WINDOW, len(own))
        forms = list(windows(own, width))
        if re.match("[A-ZÀ-ÖØ-Þ]", TOKEN.search(text)[0]):
            forms += [w for w in windows([("<name>", own[0][0])] + own[1:], width) if w[0] == 0]
        by = {}
        for at, key, slots in forms:
            by.setdefault(key, []).append((at, slots))
        for doc_id, body in docs:
            aligned = {}
            for at, key, slots in windows(tokens(body), width):
                for own_at, own_slots in by.get(key, ()):
                    seen, pairs = aligned.setdefault(at - own_at, (set(), set()))
                    seen.add(own_at)
                    pairs |= set(zip(own_slots, slots))
            for seen, pairs in aligned.values():
                if len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and len(seen) >= min(D.RUN, len(own)) - width + 1:
                    out.add((doc_id, item_id))
    return out


ITEMS = [
    (1, "If Alice buys 12 apples for 3.50 dollars and gives Bob 4 of them, how many apples does Alice have when Bob returns 2 of them to her?"),
    (2, "Le café de la gare ouvre à neuf heures du matin chaque jour"), (3, "too short here"), (4, None), (5, ""), (None, "an item without any id still has enough words in it"),
    (6, "Six words are enough for this"), (1000, "If Alice buys 12 apples for 3.50 dollars and gives Bob 4 of them, how many apples does Alice have when Bob returns 2 of them to her?"),
]


def docs_of():
    same = ITEMS[0][1]
    other = same.replace("Alice", "Carla").replace("Bob", "Dmitri").replace("12", "57").replace("3.50", "8").replace("4 of", "9 of").replace("returns 2", "returns 3")
    broken = other.replace("have when Dmitri", "have when Carla").replace("does Carla", "does Emil")
    return [
        (1, f"Some text before. {same} And after."), (2, f"noise, {other}"), (3, f"noise {broken}"), (4, same[:60]), (5, same[40:]), (6, None), (7, ""),
        (8, "x " * 40_000 + ITEMS[1][1] + " y" * 40_000), (9, "il dit que Le café de la gare ouvre à neuf heures du matin chaque jour, non"), (None, same), (11, same + "\n" + other),
        (12, "an item without any id still has enough words in it"), (12, "clean"), (12, "clean"), (13, "six words are enough for this"), (14, "six words are not enough for this"), (15, "1 2 3 4 5 6 7 8 9 " * 40),
    ]


def test_odd_rows_against_brute_force(spark):
    docs = docs_of()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, hash string, item_id int")
    bench = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id bigint, text string, at string")
    got = D.leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, ITEMS)
    assert len(got) == len({(r.doc_id, r.text_key, r.item_id) for r in got})
    by = {(r.doc_id, r.item_id): r.reworded for r in got}
    assert by[1, 1] is False and by[2, 1] is True and (3, 1) not in by and by[8, 2] is False and by[9, 2] is False
    left = sorted((r.doc_id, r.text) for r in D.without_leaks(df, bench).select("doc_id", "text").where("doc_id = 12").collect())
    assert left == [(12, "clean"), (12, "clean")]


def test_empty_tables(spark):
    df = spark.createDataFrame(docs_of(), "doc_id bigint, text string")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert D.leaks(df, bench.limit(0)).collect() == [] and D.leaks(df.limit(0), bench).collect() == []
    assert D.without_leaks(df, bench.limit(0)).count() == len(docs_of())


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op5_decontaminate(spark, sf).collect()}
    assert got == brute(docs, items)
    assert {(d, i) for d, t in docs for i, x in items if x in t and len(tokens(x)) >= D.LEAST} <= got


def held(spark, docs, items):
    got = D.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    return {(r.doc_id, r.item_id): r.reworded for r in got}


def test_case_does_not_hide_a_passage(spark):
    greek = "Ο δρόμος προς την Αθήνα είναι μακρύς και ο ήλιος καίει"
    german = "die lange Straße am Fluss ist heute für alle Wagen gesperrt"
    items = [*ITEMS, (20, greek), (21, german)]
    docs = [
        (1, ITEMS[0][1].upper()), (2, ITEMS[0][1].lower()), (3, f"NOISE. {ITEMS[1][1].upper()} MORE"), (4, greek.upper()), (5, german.upper()), (6, ITEMS[5][1].title()),
        (7, ITEMS[0][1].upper().replace("12", "57")), (8, "NOTHING OF THAT KIND STANDS IN THIS ONE AT ALL"),
    ]
    assert held(spark, docs, items) == {(1, 1): False, (1, 1000): False, (2, 1): False, (2, 1000): False, (3, 2): False, (4, 20): False, (5, 21): False, (6, None): False, (7, 1): True, (7, 1000): True}


def test_items_poor_in_words(spark):
    mostly = "Compare 12 13 14 15 16 17 with 22 23 24 25 26 27 and then say which of these 31 32 33 34 35 36 37 are larger"
    items = [
        (1, "Solve 3x + 5 = 20 for x"), (2, "Compute 12 + 35 * 4 - 7"), (3, "Add 12 and 30 then take 5 from it twice over"), (4, mostly), (5, "too short here"), (6, "Is 91 prime?"),
        (7, "Alice Bob Carol Dave Emil Frank Gina Hugo Ida Jack Karl Lena won"),
    ]
    docs = [(100 + i, f"Exercise:\n{text} And so on.") for i, text in items] + [
        (1, "Solve 3x + 5 = 21 for x"), (2, "Compute 12 + 35 * 4 - 8"), (3, "Now add 77 and 8 then take 6 from it twice over, please"), (5, "too short there, here too short"), (6, "is 91 prime. Is 93 prime?"),
        (7, "they say: alice bob carol dave emil frank gina hugo ida jack karl lena won"), (8, mostly.replace("12", "72").replace("31", "81")), (9, "Add 12 and 30 then give"), (10, "12 13 14 15 16 17"),
    ]
    wanted = {(100 + i, i): False for i, _ in items} | {(3, 3): True, (6, 6): False, (7, 7): False, (8, 4): True}
    assert held(spark, docs, items) == wanted


def test_one_changed_value_does_not_hide_a_verbatim_run(spark):
    long = (
        "The train from Paris to Lyon leaves at 2 in the morning and carries mail for the towns along the river, while the slow one "
        "from Paris waits for 4 wagons of coal at the yard and then follows it, before the last train out of Rome goes by with 2 guards on board"
    )
    docs = [(1, long.replace("Rome", "Paris")), (2, long.replace("with 2", "with 4")), (3, long), (4, long.replace("Paris", "Bonn").replace("Lyon", "Bonn").replace("2", "4").replace("river", "lake").replace("Rome", "Bonn"))]
    only = [(5, "Take 3 red balls and give Anna 4 of the balls then take 3 more")]
    assert held(spark, docs, [(1, long)]) == {(1, 1): False, (2, 1): False, (3, 1): False, (4, 1): False}
    assert held(spark, [(1, "Take 7 red balls and give Anna 7 of the balls then take 8 more")], only) == {}


TEMPLATES = [
    "{a} has {x} apples. {a} gives {y} apples to {b}. How many apples does {a} have left?",
    "{a} reads {x} pages. {b} reads {y} pages more. How many pages have they read by the evening?",
    "A train travels {x} km in {y} hours. What is its mean speed over the whole way?",
    "{a} and {b} share {x} sweets. {a} takes {y} of them. How many are there for {b} to eat?",
    "A shop sells {x} pens for {y} dollars. How much do six pens and a ruler cost there?",
    "{a} hat {x} Äpfel. {a} gibt {b} {y} Äpfel. Wie viele Äpfel hat {a} noch übrig?",
    "{a} fährt mit dem Rad {x} Kilometer in {y} Stunden. Wie schnell fährt {a} im Mittel?",
    "Ein Zug fährt um {x} Uhr in {b} ab und braucht {y} Stunden. Wann kommt er in {a} an?",
    "{a} a {x} pommes. {a} donne {y} pommes à {b}. Combien de pommes reste-t-il à {a}?",
    "Le train part de {a} avec {x} voyageurs et en laisse {y} à {b}. Combien en reste-t-il alors?",
    "{a} tiene {x} manzanas. {a} da {y} manzanas a {b}. ¿Cuántas manzanas le quedan a {a}?",
    "Un tren sale de {a} con {x} viajeros y deja {y} en {b}. ¿Cuántos quedan entonces en el tren?",
]


def test_recall_of_reworded_questions_and_no_false_hits(spark):
    """Every question asked again with other names and numbers, in figures and in words, within other text."""
    people = ["Alice", "Bob", "Carol", "Dan", "Sue", "Tom", "Élise", "Jürgen"]
    words = ["two", "seven", "twelve", "zwei", "sieben", "zwölf", "deux", "sept", "douze", "dos", "siete", "doce"]
    rng = random.Random(3)
    items, docs = [], []
    for i, t in enumerate(TEMPLATES):
        a, b, c, d = rng.sample(people, 4)
        own = {"a": a, "b": b, "x": 12, "y": 5}
        items.append((i, t.format(**own)))
        lang = 0 if i < 5 else 1 if i < 8 else 2 if i < 10 else 3
        for k, values in enumerate(({"a": c, "b": d, "x": 40, "y": 9}, {"a": d, "b": a, "x": 7.5, "y": 33}, {"a": b, "b": c, "x": words[3 * lang + 2], "y": words[3 * lang]})):
            docs.append((100 * (k + 1) + i, f"Some notes come first. {t.format(**values)} And then some more text follows it."))
    clean = [(10_000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    frames = ["{a} met {b} at the fair and they talked about the old days.", "In {x} there were {y} villages along the river near {a}.", "{a} hat {b} gestern im Garten gesehen."]
    clean += [(20_000 + j, " ".join(rng.choice(frames).format(a=rng.choice(people), b=rng.choice(people), x=rng.randrange(90), y=rng.randrange(90)) for _ in range(8))) for j in range(200)]
    found = held(spark, docs + clean, items)
    caught = {d for d, i in found if d < 1000 and d % 100 == i}
    assert len(caught) >= 0.9 * len(docs), sorted(set(d for d, _ in docs) - caught)
    assert all(found[d, d % 100] for d in caught)
    assert not [d for d, _ in found if d >= 10_000 or d < 1000 and (d, d % 100) not in found]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some words that stand here in peace", 5, 6), (2, ITEMS[5][1], 5, 6)], "doc_id bigint, text string, leaking_id bigint, leaking_key bigint")
    bench = spark.createDataFrame([(1, ITEMS[5][1])], "item_id bigint, text string")
    left = D.without_leaks(df, bench)
    assert left.columns == df.columns and [tuple(r) for r in left.collect()] == [(1, "some words that stand here in peace", 5, 6)]
