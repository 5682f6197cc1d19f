"""Text decoded with a wrong character encoding.

Method: adjacent character pairs are counted over all documents. A pair scores by
how far its mutual information falls below the bar, where a character rarer than
a floor counts as common as the floor, so that garbled characters, which stand
beside each other, do not vouch for one another. Maximum-scoring segments of
these scores are the improbable runs. Inverse mappings (encode with the wrong
encoding, decode with the right one) are tried inside the runs only, and the
mapping that makes a document's runs most probable under the pair counts is
applied, up to three times over for text garbled repeatedly.

Bound: pairs in at least SHARE of the documents have entries in the model, so its
size is bounded by the distinct pairs of a document over SHARE, however many
documents there are; all pairs are counted, and a pair without an entry counts as
half the least that has one.

Defined results
  * a text is a case if some mapping makes its runs clearly more probable, or if
    an improbable run holds U+FFFD or a C1 control, which no right decoding leaves;
  * what cannot be regained stays as it is; null and empty texts are not cases;
  * repeated rows each have a result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import script
from quirefold.session import staged

#: Share of the documents, and the least number of them, for an entry of the model.
SHARE, LEAST = 2e-5, 2
#: Share of the documents in its script that a rare character counts for, and the bar in nats.
FLOOR, BAR = 0.08, 1.2
#: Gain in nats that a mapping needs over a document, over a single run and, unless it
#: ends in UTF-8, whose sequences are hardly met by chance, for each character.
GAIN, RUN_GAIN, CHANGE_GAIN = 7.0, 3.0, 1.0
NEAR = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+[\x00-\x7f]?")
BROKEN = re.compile("[\ufffd\x80-\x84\x86-\x9f]")
PLAIN = math.log(0.05)
STRAY, STRAYS, PLAIN_BYTES = re.compile("[\udc80-\udcff]"), re.compile("[\udc80-\udcff]+"), re.compile(rb"[\x00-\x7f]")
#: Key of the number of documents that hold a script.
SCRIPT = "script "

#: Encodings that text was read in, with those it was written in.
WESTERN = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5")
MAPPINGS = (
    *((w, "utf_8") for w in ("latin_1", *WESTERN, *CYRILLIC, "gbk", "cp932", "cp1253", "cp874", "cp1256")),
    *((w, r) for w in WESTERN for r in WESTERN if w != r),
    *((w, r) for w in CYRILLIC for r in CYRILLIC if w != r),
    *((w, r) for w in ("latin_1", "cp1252", "mac_roman", "cp437") for r in (*CYRILLIC, "cp1253", "iso8859_7", "cp1256", "cp874", "gbk", "cp932", "euc_jp", "big5")),
    *((w, r) for w in CYRILLIC[:3] for r in ("cp1252", "gbk", "cp1253")),
    *(("latin_1", r) for r in ("cp1252", "mac_roman", "cp437", "cp850")),
    ("gbk", "cp932"), ("gbk", "euc_jp"), ("gbk", "cp1251"), ("gbk", "big5"), ("cp932", "gbk"), ("cp932", "euc_jp"),
)


WAYS: dict[str, list[str]] = {}
for _wrong, _right in dict.fromkeys(MAPPINGS):
    WAYS.setdefault(_wrong, []).append(_right)


def _loose(name: str) -> dict[int, str]:
    """Code points of a single-byte encoding as those of latin-1; undefined bytes stand for themselves."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        out[ord(c)] = chr(b)
    # a character that the encoding lacks must not pass as the latin-1 byte
    for b in range(128, 256):
        out.setdefault(b, "\ufffd")
    return out


_LOOSE = {w: _loose(w) for w, _ in MAPPINGS if w not in ("gbk", "cp932")}


def encoded(run: str, wrong: str) -> bytes | None:
    """The bytes of a run before it was read wrongly; None if they cannot be told."""
    try:
        table = _LOOSE.get(wrong)
        return run.encode(wrong) if table is None else run.translate(table).encode("latin_1")
    except UnicodeEncodeError:
        return None


def restored(run: str, wrong: str, right: str) -> str | None:
    """The run with its bytes read rightly; in UTF-8, bytes that do not fit stay as they were."""
    raw = encoded(run, wrong)
    if raw is None:
        return None
    if right != "utf_8":
        try:
            got = raw.decode(right)
        except UnicodeDecodeError:
            return None
        return None if got == run else got
    try:
        got = raw.decode("utf_8")
    except UnicodeDecodeError:
        got = raw.decode("utf_8", "surrogateescape")
        lost = len(STRAY.findall(got))
        if 4 * lost > len(raw) - len(PLAIN_BYTES.findall(raw)):
            return None
        if wrong in ("gbk", "cp932"):
            # lead and trail bytes cannot be shown alone
            got = STRAYS.sub("\ufffd", got)
        else:
            got = STRAY.sub(lambda m: bytes([ord(m.group()) - 0xDC00]).decode(wrong, "replace"), got)
    return None if got == run else got


def least_documents(documents: int) -> int:
    """How many documents must hold a pair that has an entry."""
    return max(LEAST, round(SHARE * documents))


class Pairs:
    """Log shares of documents of characters and adjacent pairs."""

    def __init__(self, count: dict[str, int], documents: int):
        self.n = max(1, documents)
        self.count = count
        self.unseen = math.log(0.15 * least_documents(self.n) / self.n)
        self.memo: dict[str, float] = {}
        self.bad: dict[str, float] = {}
        self.scripts = {k[len(SCRIPT) :]: v for k, v in count.items() if k.startswith(SCRIPT)}
        self.tried: dict[str, list] = {}

    def share(self, pair: str) -> float:
        got = self.memo.get(pair)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            if pair.isascii():
                got = PLAIN
            else:
                c = self.count.get(pair)
                got = math.log(c / self.n) if c else self.unseen
                if "\ufffd" in pair or "\x80" <= pair[0] < "\xa0" or "\x80" <= pair[-1] < "\xa0":
                    got = self.unseen - 2.0
            self.memo[pair] = got
        return got

    def improbable(self, pair: str) -> float:
        """Positive for a pair whose floored mutual information is below the bar.

        Two letters of one script are judged among the documents in that script.
        """
        got = self.bad.get(pair)
        if got is not None:
            return got
        if len(self.bad) > 500_000:
            self.bad.clear()
        x, y = pair
        if pair.isascii():
            got = -1.0
        else:
            one, two = script(x), script(y)
            if one in "HK" and two in "HK":
                one = two = "H"
            # a blank, digit or mark goes with any script; a Latin letter does not
            if x <= "\x7f" and not x.isalpha():
                one = two
            elif y <= "\x7f" and not y.isalpha():
                two = one
            same = max(1, self.scripts.get(one, 1)) / self.n if one == two and one not in "LO" else 1.0
            a = max(self.count.get(x, 0) / self.n / same, FLOOR) if x > "\x7f" else 0.6
            b = max(self.count.get(y, 0) / self.n / same, FLOOR) if y > "\x7f" else 0.6
            got = -(self.share(pair) - math.log(same) - math.log(a) - math.log(b)) - BAR
        self.bad[pair] = got
        return got

    def score(self, text: str) -> float:
        share = self.share
        known = self.memo.get
        return sum([share(x) if (y := known(x)) is None else y for x in map(add, text, text[1:])])


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments (Ruzzo and Tompa), as half-open index ranges."""
    found: list[list] = []  # start, end, sum before start, sum at end
    total = 0.0
    for i, x in enumerate(scores):
        if x <= 0:
            total += x
            continue
        new = [i, i + 1, total, total + x]
        total += x
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b) for a, b, _, _ in found]


def runs(text: str, model: Pairs) -> list[tuple[int, int]]:
    """Improbable runs as (start, end), widened to whole stretches beyond ASCII."""
    out: list[tuple[int, int]] = []
    improbable, known = model.improbable, model.bad.get
    stretches: list[list[int]] = []
    for m in NEAR.finditer(text):
        # short plain pieces inside a run may be trail bytes
        if stretches and m.start() - stretches[-1][1] <= 4:
            stretches[-1][1] = m.end()
        else:
            stretches.append([m.start(), m.end()])
    for a, b in stretches:
        piece = text[a:b]
        scores = [improbable(x) if (y := known(x)) is None else y for x in map(add, piece, piece[1:])]
        if not scores or max(scores) <= 0:
            continue
        for i, j in segments(scores):
            s, e = a + i, a + j + 1
            while s > a and text[s] > "\x7f" and text[s - 1] > "\x7f":
                s -= 1
            while e < b and text[e - 1] > "\x7f" and text[e] > "\x7f":
                e += 1
            if s < e and text[s] <= "\x7f":
                s += 1
            if s < e and text[e - 1] <= "\x7f" and text[e - 2 : e - 1] <= "\x7f":
                e -= 1
            if s >= e:
                continue
            if out and s <= out[-1][1]:
                out[-1] = (out[-1][0], max(e, out[-1][1]))
            else:
                out.append((s, e))
    return out


def gains_of(before: str, run: str, after: str, model: Pairs) -> list[tuple]:
    """(mapping, restored run, gain) of every mapping that makes the run more probable."""
    got, known = [], {}
    old = model.score(before + run + after)
    letters = sum(c > "\x7f" and c.isalpha() for c in run)
    dense = sum(c > "\u2fff" for c in run) * 2 > len(run)
    for wrong, rights in WAYS.items():
        if dense != (wrong in ("gbk", "cp932")) and (dense or not any(c > "\u2fff" for c in run)):
            continue
        if encoded(run, wrong) is None:
            continue
        for right in rights:
            if wrong in CYRILLIC and right in CYRILLIC and letters < 4:
                continue  # between alphabets in one script, short words tell nothing
            new = restored(run, wrong, right)
            if new is None:
                continue
            gain = known.get(new)
            if gain is None:
                gain = known[new] = model.score(before + new + after) - old
            if gain > RUN_GAIN and (right == "utf_8" or gain > CHANGE_GAIN * sum(c > "\x7f" for c in new)):
                got.append(((wrong, right), new, gain))
    return got


def repair(text: str, model: Pairs) -> tuple[str, int, str]:
    """(text as far as regained, runs changed, mappings used)."""
    changed, used = 0, []
    for _ in range(3):
        found = runs(text, model)
        if not found:
            break
        gains: Counter = Counter()
        ways: dict[tuple[str, str], dict[str, tuple[str, float]]] = {}
        for s, e in found:
            before, after = text[s - 1 : s] or " ", text[e : e + 1] or " "
            key = before + text[s:e] + after
            got = model.tried.get(key)
            if got is None:
                if len(model.tried) > 50_000:
                    model.tried.clear()
                got = model.tried[key] = gains_of(before, text[s:e], after, model)
            for way, new, gain in got:
                gains[way] += gain
                ways.setdefault(way, {})[key] = (new, gain)
        if not gains:
            break
        way, gain = max(gains.items(), key=lambda x: x[1])
        if gain < GAIN:
            break
        out, at = [], 0
        for s, e in found:
            key = (text[s - 1 : s] or " ") + text[s:e] + (text[e : e + 1] or " ")
            if key in ways[way]:
                out.append(text[at:s])
                out.append(ways[way][key][0])
                at = e
                changed += 1
        out.append(text[at:])
        text = "".join(out)
        used.append(f"{way[1]} read as {way[0]}")
    return text, changed, "; ".join(used)


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row id, text) -> documents that hold each character and pair beyond ASCII."""
    total: Counter = Counter()

    def flush():
        keys = list(total)
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([total[k] for k in part], pa.int64())], names=["pair", "n"]
            )
        total.clear()

    for batch in batches:
        for text in batch.column(1).to_pylist():
            if not text:
                continue
            total[""] += 1
            if text.isascii():
                continue
            own: set[str] = set()
            for piece in NEAR.findall(text):
                own.update(piece)
                own.update([a + b for a, b in zip(piece, piece[1:])])
            marks = {script(c) for c in own if len(c) == 1 and c > "\x7f"}
            if "K" in marks:
                marks.add("H")
            total.update(own)
            total.update([SCRIPT + m for m in marks])
        if len(total) > 1_000_000:
            yield from flush()
    yield from flush()


def train(rows: DataFrame) -> tuple[dict[str, int], int]:
    """Counts over all rows (row_id, text); entries of pairs in enough documents come to the driver."""
    counts = staged(
        rows.select("row_id", "text").mapInArrow(count_pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    )
    documents = counts.filter("pair = ''").agg(F.sum("n")).first()[0] or 0
    kept = counts.filter(F.col("pair").startswith(SCRIPT) | (F.col("n") >= least_documents(documents)) & (F.col("pair") != ""))
    return {r[0]: r[1] for r in kept.collect()}, documents


def broken(text: str, model: Pairs) -> bool:
    """Whether an improbable run of a text holds what no right decoding leaves."""
    if not BROKEN.search(text):
        return False
    padded = f" {text} "  # a character alone has a neighbour, too
    return any(BROKEN.search(padded, s, e) for s, e in runs(padded, model))


def mend(model):
    """``model``: a Spark broadcast of (counts, documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Pairs(*model.value)
        for batch in batches:
            rows, texts, found, counts, ways = [], [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new, changed, used = text, 0, ""
                bad = False
                if text and not text.isascii():
                    new, changed, used = repair(text, pairs)
                    bad = changed > 0 or broken(text, pairs)
                rows.append(row)
                texts.append(new)
                found.append(bad)
                counts.append(changed)
                ways.append(used)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(texts, pa.string()), pa.array(found, pa.bool_()), pa.array(counts, pa.int64()), pa.array(ways, pa.string())],
                names=["row_id", "text", "garbled", "runs", "mapping"],
            )

    return run


def ungarbled(rows: DataFrame) -> DataFrame:
    """Every row (row_id, text): text as far as regained, garbled, runs, mapping."""
    rows = rows.select(F.col("row_id").cast("long").alias("row_id"), "text")
    model = rows.sparkSession.sparkContext.broadcast(train(rows))
    return rows.mapInArrow(mend(model), "row_id long, text string, garbled boolean, runs long, mapping string")
