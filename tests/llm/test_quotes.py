import duckdb
import pyarrow as pa
import pytest

from feedlake.llm import oracle
from feedlake.llm import quotes as Q

SCHEMA = "conv_id bigint, turn int, role string, text string, body string, depth int"
FIRST = "Which way is best?\nI have tried\ntwo so far.\n\nAlso: what now?"
ROWS = [
    (1, 0, "user", FIRST), (1, 1, "assistant", "On Monday, A wrote:\n> Which way is BEST? I have  tried\n> two so far.\n\nThe left one."),
    (1, 2, "user", "> > which way is best? i have tried two so far.\n> The left one.\r\nWhy that?"), (1, 3, "user", "> also: what now?\nUnasked."),
    (1, 4, "assistant", ">> The left one.\n> Why that?\nBecause."), (1, 5, "user", "> never said\nhm"), (1, 6, "user", "  >  > \n>\n"), (1, 7, "user", "> Unasked.\n\n> Because.\nBoth."),
    (2, 0, "user", "The left one."), (2, 1, "user", "> Because.\nother conversation"), (2, 1, "user", "> The left one.\ntwin"), (2, 1, "user", "> The left one.\ntwin"),
    (None, None, None, None), (None, 3, "user", "> x"), (None, 2, "user", "x"), (3, None, "user", "start"), (3, 1, None, "> start\n> > start\nyes"), (4, 0, "user", ""), (4, 9, "user", "He wrote:\nno quote follows"),
    (5, 0, "user", "long " * 40_000), (5, 1, "user", "> " + "long " * 40_000 + "\nok"), (6, 0, "user", "a\n" * 20_000), (6, 1, "user", "> a\n" * 3),
] + [(7, i, "user", f"> line {i - 1}\nline {i}") for i in range(40)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def answer(spark):
    return Q.conversations(frame(spark, ROWS)).collect()


def test_against_sql(answer):
    con = duckdb.connect()
    con.register("conversations", pa.table({c: pa.array([r[i] for r in ROWS]) for i, c in enumerate(("conv_id", "turn", "role", "text"))}))
    rel = con.sql(oracle.SQL["op9_quotes"])
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    key = lambda d: repr(sorted(d.items()))
    assert sorted(map(key, want)) == sorted(key(r.asDict()) for r in answer)


def test_links_and_order(answer):
    one = {r.turn: r for r in answer if r.conv_id == 1}
    assert [one[t].reply_to for t in range(8)] == [None, 0, 1, 0, 2, None, None, 4]
    assert [one[t].depth for t in range(8)] == [0, 1, 2, 1, 3, 0, 0, 4]
    assert [one[t].body for t in (1, 2, 4, 7)] == ["The left one.", "Why that?", "Because.", "Both."]
    assert one[0].body == FIRST and one[2].quote_levels == 2
    order = [r.turn for r in sorted((r for r in answer if r.conv_id == 1), key=lambda r: r.position)]
    assert order == [0, 1, 3, 2, 4, 7, 5, 6]
    chain = {r.turn: r for r in answer if r.conv_id == 7}
    assert chain[39].depth == 39 and chain[39].thread_root == 0
    assert {r.reply_to for r in answer if r.conv_id == 2 and r.turn == 1} == {0}
    assert len(answer) == len(ROWS)


def test_empty_table(spark):
    assert Q.conversations(frame(spark, [])).collect() == []


def test_no_python_on_the_executors(spark):
    plan = Q.conversations(frame(spark, ROWS[:8]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_trimmed_quotes_link(spark):
    first = "The bridge is closed today. Use the ferry at noon!\nIt leaves from the north pier\nand takes an hour."
    rows = [
        (1, 0, "user", first), (1, 1, "assistant", "Thanks, I did not know about that.\nWhat does it cost?"), (1, 2, "user", "> use the FERRY\n> at noon!\nWhich one?"),
        (1, 3, "user", "> It leaves from the north pier\nSure?"), (1, 4, "user", "> What does it cost?\nTwo."), (1, 5, "user", "> > The bridge is closed today.\n> Which one?\nThe red one."),
        (1, 6, "user", "> What does it cost?\n> A line that nobody has ever written in here\nhm"), (1, 7, "user", "> and takes\nno whole line"), (2, 1, "user", "> Use the ferry at noon!\nother conversation"),
    ]
    got = {(r.conv_id, r.turn): r.reply_to for r in Q.conversations(frame(spark, rows)).collect()}
    assert got == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 0, (1, 4): 1, (1, 5): 2, (1, 6): None, (1, 7): None, (2, 1): None}
