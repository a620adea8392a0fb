"""Benchmark passages in documents, found by their templates.

A text becomes a sequence of tokens in which numbers (in figures or words), units after numbers and names
(capitals within a sentence) are typed placeholders and all else is the word in lower case.  Windows of ``WINDOW`` template
tokens are hashed on both sides and joined.  What stands in the placeholders decides then: along one
alignment of an item with a document every value of the item must always meet the same value of the
document, and the other way round.  So a question asked again with other numbers and names is caught,
and words that merely share a frame are not.

Whether a capital at the start of a sentence is a name can't be seen, so windows with one have a form more,
in which all capitals are names: whichever it is, the forms of both sides meet.

Every window has another form, of the text without its case (``str.casefold``): only numbers and units are
placeholders there, so text in capitals, or in small letters throughout, is found as well.  Both forms
have the same tokens at the same places, and a window matches if either does.

Windows with few words say little by their template: they are hashed with the values in, in the form
without case, and so match exact copies only.  Items of fewer than ``LEAST`` tokens are matched by their
exact values in the same way.

A document holds an item if an alignment matches at least as many windows as ``RUN`` tokens in a row
have, or all windows of a shorter item.  Windows that hold the item's own values count by themselves: if
they are enough, no other value elsewhere takes that back.  Where changed values are relied on, all of the
alignment must be one-to-one.  An item of which too few windows have words enough to be found
with other values also gets windows of ``RUN`` tokens, or of its whole length; one of these is enough.
An item's first word may stand within a sentence of the document, so its first
window is also kept with a name in that place.

Documents are scanned whole.  Windows that no item can have are left out before the join by a bit table
of fixed size, broadcast with the scan; a benchmark of any size only lets more windows through.

Null and empty texts have no windows; a null id is matched as any other; rows repeated under one id and
text count once; extra columns are ignored; either table may be empty.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm import hashing
from feedlake.llm.jaccard_join import sequences
from feedlake.llm.shared import map_arrow, materialise, small_side
from feedlake.llm.words import LOWER, NO_WORD, parts, spans

WINDOW, RUN, LEAST = 8, 13, 5
LITERALS = 4  # words, not placeholders, of a window that is told by its template (all but one of a shorter window)
FILTER_BITS = 1 << 23
PART_BYTES = 1 << 20

# --- fixed values: units and numbers in the words of four languages (no words that are articles as well)
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g gram grams kg kilogram kilograms t ton tons lb lbs pound pounds oz ounce ounces "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mph kmh hz khz mhz ghz w kw kwh v a j kj cal kcal pa kpa bar k c f degree degrees percent cent cents dollar dollars usd eur euro euros gbp yen "
    "kb mb gb tb bit bits byte bytes meter meters metre metres kilometer kilometers kilometre kilometres "
    "gramm kilogramm tonnen sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren grad prozent meilen "
    "gramme grammes kilos litres heure heures jour jours semaine semaines mois an ans année années degrés mètre mètres kilomètre kilomètres secondes "
    "gramos kilo litro litros hora horas minuto minutos segundo segundos día días semana semanas mes meses año años grado grados metro metros kilómetro kilómetros dólares"
).split()
NUMBERS = (
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty "
    "seventy eighty ninety hundred thousand million "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig dreissig vierzig "
    "fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante mille "
    "cero dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil"
).split()
# --- end of fixed values
NUMBER, UNIT, NAME = 1, 2, 3
_MARK = np.array([0, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B], np.uint64)
_EXACT = np.uint64(0xA54FF53A5F1D36F1)
_digit = np.array([48 <= b <= 57 for b in range(256)])
_upper = np.array([65 <= b <= 90 for b in range(256)])
_point = np.array([b in b".," for b in range(256)])
_stop = np.array([b in b".!?:;\n" for b in range(256)])


def _lowered(body: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the accented letters of two bytes that begin with C3."""
    low = LOWER[body]
    accented = np.zeros(len(body), bool)
    accented[1:] = (body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)
    low[accented] += 0x20
    return low


def _hashes(words: list[str]) -> np.ndarray:
    body = np.frombuffer(" ".join(words).encode(), np.uint8)
    first, last, _ = spans(body, np.array([len(body)]))
    return np.sort(hashing.Rolling(body)(first, last))


_UNITS, _NUMBERS = _hashes(UNITS), _hashes(NUMBERS)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Templates:
    """Tokens of a block: template hash, hash of what stands there, kind of placeholder (0: none), row.

    Capitals within sentences make placeholders for ``names`` "inner", all capitals for "all", none for "none".
    """

    def __init__(self, body: np.ndarray, lengths: np.ndarray, names: str = "inner"):
        blank = NO_WORD[body]
        if len(body) > 2:  # a point or comma between two digits is part of the number
            inner = _point[body[1:-1]] & _digit[body[:-2]] & _digit[body[2:]]
            blank[1:-1] &= ~inner
        first, last, self.row = spans(body, lengths, blank)
        low = _lowered(body)
        self.value = hashing.Rolling(low)(first, last)
        n = len(first)
        self.kind = np.zeros(n, np.int64)
        if not n:
            self.token = self.value
            return
        number = _digit[body[first]] | _among(self.value, _NUMBERS)
        stops = np.append(0, np.cumsum(_stop[body]))
        inside = np.append(False, (self.row[1:] == self.row[:-1]) & (stops[first[1:]] == stops[last[:-1]]))
        second = body[np.minimum(first + 1, len(body) - 1)]
        capital = _upper[body[first]] | ((body[first] == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        if names != "none":
            self.kind[capital & (inside | (names == "all"))] = NAME
        after = np.append(False, number[:-1] & (self.row[1:] == self.row[:-1]))
        self.kind[after & _among(self.value, _UNITS)] = UNIT
        self.kind[number] = NUMBER
        self.token = np.where(self.kind > 0, _MARK[self.kind], self.value)
        self.capital = capital

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows within one document that have words enough, and their hashes."""
        every = sequences(self.token, width)
        at = np.flatnonzero(self._within(width) & self._wordy(width))
        return at, every[at]

    def exact_windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the other windows, and hashes of their values."""
        every = hashing.mix(sequences(self.value, width) ^ _EXACT)
        at = np.flatnonzero(self._within(width) & ~self._wordy(width))
        if width < LEAST:  # a whole item: one of a kind tells as much as all
            _, one = np.unique(np.stack([self.row[at].astype(np.uint64), every[at]]), axis=1, return_index=True)
            at = at[np.sort(one)]
        return at, every[at]

    def _within(self, width: int) -> np.ndarray:
        n = max(len(self.row) - width + 1, 0)
        return self.row[width - 1 :] == self.row[:n]

    def _wordy(self, width: int) -> np.ndarray:
        n = max(len(self.row) - width + 1, 0)
        if width < LEAST:
            return np.zeros(n, bool)
        literal = np.append(0, np.cumsum(self.kind == 0))
        return literal[width:] - literal[:n] >= min(LITERALS, width - 1)


def folded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of texts without their case; no word begins or ends elsewhere by that."""
    plain = [t.decode().casefold().encode() for t in texts]
    return np.frombuffer(b"".join(plain), np.uint8), np.array([len(t) for t in plain], np.int64)


ITEMS = "item_id bigint, tokens int, at int, width int, hash bigint, slots array<bigint>"
_SLOTS = pa.list_(pa.int64())


def _signed(values: np.ndarray) -> list:
    return values.view(np.int64).tolist()


def _item_windows(batches):
    for batch in batches:
        out = {c: [] for c in ("item_id", "tokens", "at", "width", "hash", "slots")}
        for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            body = np.frombuffer((text or "").encode(), np.uint8)
            plain = Templates(body, np.array([len(body)]))
            n = len(plain.token)
            if not n:
                continue
            opened = Templates(body, np.array([len(body)]), "all")
            caseless = Templates(*folded([body.tobytes()]), "none")
            width, run = min(WINDOW, n), min(RUN, n)
            # (width, form, places, hashes)
            found = []
            for form in (plain, opened):
                found.append((width, form, *form.windows(width)))
                if LEAST <= width < run and len(found[-1][2]) < run - width + 1:
                    found.append((run, form, *form.windows(run)))
            few = any(w == run > width for w, *_ in found)
            if plain.capital[0] and not plain.kind[0]:
                named = Templates(body, np.array([len(body)]))
                named.kind[0], named.token[0] = NAME, _MARK[NAME]
                for w in (width, run) if few else (width,):
                    at, hashes = named.windows(w)
                    found.append((w, named, at[:1][at[:1] == 0], hashes[:1][at[:1] == 0]))
            found += [(width, caseless, *caseless.windows(width)), (width, caseless, *caseless.exact_windows(width))]
            if few:
                found.append((run, caseless, *caseless.windows(run)))
            seen = set()
            for width, form, at, hashes in found:
                for a, h in zip(at.tolist(), _signed(hashes)):
                    if (width, a, h) in seen:
                        continue
                    seen.add((width, a, h))
                    slot = form.value[a : a + width][form.kind[a : a + width] > 0]
                    for c, v in zip(out, (item_id, n, a, width, h, _signed(slot))):
                        out[c].append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["item_id"], pa.int64()), *(pa.array(out[c], pa.int32()) for c in ("tokens", "at", "width")), pa.array(out["hash"], pa.int64()), pa.array(out["slots"], _SLOTS)], list(out)
        )


DOCUMENT_WINDOWS = "doc_id bigint, text_key bigint, doc_at int, width int, hash bigint, doc_slots array<bigint>"


def _document_windows(sent, widths: list[int]):
    def windows(batches):
        table = sent.value
        for batch in batches:
            for a, _, body, lengths in parts(batch, 2, PART_BYTES):
                ends = np.cumsum(lengths).tolist()
                whole = body.tobytes()
                plain, opened = Templates(body, lengths), Templates(body, lengths, "all")
                caseless = Templates(*folded([whole[e - n : e] for e, n in zip(ends, lengths.tolist())]), "none")
                starts = np.searchsorted(plain.row, np.arange(len(lengths)))
                for width in widths:
                    first = np.zeros(len(plain.token), np.uint64)  # the plain windows' hashes: equal ones aren't sent again
                    each = ((plain, plain.windows(width)), (opened, opened.windows(width)), (caseless, caseless.windows(width)), (caseless, caseless.exact_windows(width)))
                    for forms, (at, hashes) in each:
                        place = hashes % np.uint64(FILTER_BITS)
                        some = (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
                        some &= first[at] != hashes
                        at, hashes = at[some], hashes[some]
                        if forms is plain:
                            first[at] = hashes
                        rows = forms.row[at]
                        taken = pa.array(rows + a)
                        slots = [_signed(forms.value[k : k + width][forms.kind[k : k + width] > 0]) for k in at.tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(taken), batch.column(1).take(taken), pa.array((at - starts[rows]).astype(np.int32)), pa.array(np.full(len(at), width, np.int32)), pa.array(hashes.view(np.int64)), pa.array(slots, _SLOTS)],
                            ["doc_id", "text_key", "doc_at", "width", "hash", "doc_slots"],
                        )

    return windows


def text_key(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, item_id, windows, item_windows, reworded of every document that holds an item.

    ``windows`` of the item's ``item_windows`` match along the best alignment, only those with the item's
    own values where its values aren't one-to-one; ``reworded`` says that placeholders hold other values
    than the item's.
    """
    spark = docs.sparkSession
    items = materialise(benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).transform(map_arrow, _item_windows, ITEMS), "decontaminate-items")
    # at most FILTER_BITS rows, and at most RUN widths
    set_bits = items.select(F.expr(f"pmod(hash, {FILTER_BITS})").alias("bit")).distinct().toPandas()["bit"].to_numpy()
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    table = np.zeros(FILTER_BITS, np.uint8)
    table[set_bits] = 1
    sent = spark.sparkContext.broadcast(np.packbits(table, bitorder="little"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    windows = materialise(texts.transform(map_arrow, _document_windows(sent, widths), DOCUMENT_WINDOWS), "decontaminate-windows")

    met = windows.join(items, ["width", "hash"]).select(
        "doc_id", "text_key", "item_id", "tokens", "width", "at", (F.col("doc_at") - F.col("at")).alias("shift"), F.arrays_zip(F.col("slots").alias("own"), F.col("doc_slots").alias("other")).alias("pairs"),
    ).withColumn("same", F.forall("pairs", lambda p: p["own"] == p["other"]))
    along = ["doc_id", "text_key", "item_id", "shift"]
    pair = met.withColumn("pair", F.explode_outer("pairs")).groupBy(*along, "tokens", "width", "at", "pair").agg(F.max("same").alias("same"))
    aligned = pair.groupBy(*along, "tokens", "width").agg(
        F.count_distinct("at").alias("windows"), F.count_distinct(F.when(F.col("same"), F.col("at"))).alias("verbatim"),
        F.collect_set("pair").alias("pairs"), F.collect_set("pair.own").alias("owns"), F.collect_set("pair.other").alias("others"),
    )
    one_to_one = (F.size("pairs") == F.size("owns")) & (F.size("pairs") == F.size("others"))
    enough = F.least(F.lit(RUN), "tokens") - F.col("width") + 1
    aligned = aligned.withColumn("consistent", one_to_one).where((F.col("consistent") & (F.col("windows") >= enough)) | (F.col("verbatim") >= enough))
    counted = F.when(F.col("consistent"), F.col("windows")).otherwise(F.col("verbatim")).alias("windows")
    best = F.max(F.struct(counted, (F.col("consistent") & F.exists("pairs", lambda p: p["own"] != p["other"])).alias("reworded"), (F.col("tokens") - F.col("width") + 1).alias("item_windows"))).alias("best")
    return aligned.groupBy("doc_id", "text_key", "item_id").agg(best).select(
        "doc_id", "text_key", "item_id", F.col("best.windows").alias("windows"), F.col("best.item_windows").cast("bigint").alias("item_windows"), F.col("best.reworded").alias("reworded")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    mark = f"leak_{uuid.uuid4().hex}"
    found = materialise(leaks(docs, benchmark).select(F.col("doc_id").alias(f"{mark}_id"), F.col("text_key").alias(f"{mark}_key")).distinct(), "decontaminate-found")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(f"{mark}_id")) & (text_key(F.col("text")) == F.col(f"{mark}_key"))
    return docs.join(small_side(found), same, "left_anti")
