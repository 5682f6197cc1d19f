"""Sentence boundaries across languages and scripts.

Method: a hidden-event n-gram language model. Between two words stands an
unseen event, boundary or none; the model has the probability of the event
after the words on its left and of the next word (or the block's end) after the
event. It is trained on all texts without labels: block ends inside a text are
certain boundaries, and expectation maximisation shares out the rest. Forward
and backward sums over runs of neighbouring events give each boundary's
posterior. Events are possible after end marks and, in Thai, at spaces; text in
quotation marks has none. Blocks without any mark are one sentence here, as TESTDATA
wants; ``unmarked.sentences_between_words`` puts events between all of their words.

Left contexts are the word with its marks, for numbers and very short words also
with the word before, backed off to a shape. Left contexts that make up a share of
their group's events have entries of their own, as do next words, so the model's
size is bounded at any number of texts; all statistics are counted over all texts.

Defined results
  * a blank line ends a sentence, a single line break never does by itself;
  * null and blank texts have no sentences; repeated rows each have theirs;
  * a quotation that the edge of a text cuts reaches from or to that edge.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import script
from quirefold.session import staged

#: Share of its group's events, and the least count, that give a left context an entry.
SHARE, LEAST = 2e-5, 15
#: Weight of the shape's share in a left context's own share, of the common
#: next-word distribution in its own, and rounds of expectation maximisation.
#: Words of four letters or more lean on their shape more, lest one text that is
#: repeated often passes for a rule.
PRIOR, SMOOTH, ROUNDS = 4.0, 20.0, 8
WORD_PRIOR, WORD_SMOOTH = 15.0, 100.0

CLOSING = "”’»)]」』）】›》〉｝}"
STRONG = "!?…。！？؟।॥｡"
BLANK = re.compile(r"\n[^\S\n]*\n\s*")
#: An end mark with the marks and closing signs after it. A straight or low-high
#: quotation mark closes only before white space, an end, or more punctuation.
MARK = re.compile(
    r"(?:[.!?…。！？؟।॥．｡]|(?<=[Ͱ-Ͽἀ-῿])[;;])"
    rf"(?:[.!?…。！？؟।॥．｡{re.escape(CLOSING)}]|[\"“](?=\s|$|[.,;:)」』）]))*[\u200b-\u200d\u2060\ufeff\u00ad]*"
)
THAI_GAP = re.compile(r"(?<=[ก-\u0e3aเ-\u0e4e”])[^\S\n]+(?=[ก-\u0e3aเ-\u0e4e“])")
QUOTE = re.compile(r"[“”„«»\"「」『』]")
PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』"}
NO_SPACE_NEXT = re.compile(r"[0-9０-９⺀-鿿ぁ-ヿ豈-﫿\U00020000-\U0003ffff“「『（《【]")
ZERO_WIDTH = dict.fromkeys(map(ord, "\u200b\u200c\u200d\u2060\ufeff\u00ad"))
HIDDEN = frozenset(map(chr, ZERO_WIDTH))
#: Marks that need no space after them.
EAST = frozenset("。！？｡")
BLOCK_END = "</b>"
BLOCK_START = "<b>"


def clean(word: str) -> str:
    if word.isascii():
        return word.lower()
    return unicodedata.normalize("NFKC", word).translate(ZERO_WIDTH).lower()


_right_seen: dict[str, str] = {}


def right_key(token: str) -> str:
    """Class of the next word: capitalised and very short words as they are (the
    model keeps the common ones), others by shape."""
    key = _right_seen.get(token)
    if key is None:
        if len(_right_seen) > 200_000:
            _right_seen.clear()
        key = _right_seen[token] = _right_key(token)
    return key


def _right_key(token: str) -> str:
    word = token if token.isascii() else unicodedata.normalize("NFKC", token).translate(ZERO_WIDTH)
    if not word:
        return "-"
    first = word[0]
    if first in "“\"«„「『":
        return "“"
    if first in "(（[":
        return "("
    if first in "¿¡":
        return first
    if first.isdigit():
        return "#"
    if not first.isalpha():
        return "-"
    kind = script(first)
    if kind == "K":
        return first
    if kind == "T":
        return word if len(word) <= 6 else "T"
    if kind in "HAD":
        return kind
    core = word.rstrip(",;:!?)”»\"’")
    if first.isupper() and len(core) > 1 and core.isalpha():
        return core.capitalize() if core.isupper() else core
    core = core.rstrip(".")
    if len(core) <= 3 and core.isalpha():
        return core
    if first.islower():
        return kind + ("xX" if core[:2] != core[:2].lower() else "x")
    return kind + "X"


def left_shape(word: str, run: str) -> str:
    tail = "." if run[0] == "." and run.count(".") == len(run) == 1 else run
    if not word:
        return "?" + tail
    if any(c.isdigit() for c in word):
        return "#" + tail
    if "." in word:
        return "a.b" + tail
    if len(word) == 1:
        return "x" + tail
    return ("X" if word[0].isupper() else "x") + ("s" if len(word) <= 3 else "l") + tail


_left_seen: dict[tuple[str, str], tuple] = {}


def left_key(word: str, run: str) -> tuple[str | None, str, str, str | None]:
    """(script, left context, shape, key to join with the word before) of a marked word."""
    got = _left_seen.get((word, run))
    if got is None:
        if len(_left_seen) > 300_000:
            _left_seen.clear()
        got = _left_seen[(word, run)] = _left_key(word, run)
    return got


def _left_key(word: str, run: str) -> tuple[str | None, str, str, str | None]:
    word = word.split()[-1] if word and not word.isspace() and not word[-1].isspace() else ""
    group = next((g for c in reversed(word) if c.isalpha() and (g := script(c)) != "O"), None)
    if run[0] not in ".．" or any(c in run for c in "”“\"»」』"):
        return group, run, run, None
    word = word.lstrip("(（[“\"«„'‘¿¡")
    shape = left_shape(word, run)
    if any(c.isdigit() for c in word):
        key = ("#4" if len(word) == 4 else "#2" if len(word) <= 2 else "#3") if word.isdigit() else "#."
    elif len(word) > 24:
        key = shape
    else:
        key = clean(word)
    return group, key + run, shape, key + run if key[0] == "#" or len(key) == 1 else None


#: Frequent short words by which texts in Latin script are told apart.
LATIN = {
    "en": "the of and was", "de": "die der und wurde", "fr": "le les et du par", "es": "el los y una del fue",
    "it": "il gli della nel che", "pt": "os uma não são pelo", "ca": "els amb dels aquest", "ro": "și este care pentru",
    "nl": "het een van niet voor", "da": "og ikke blev af", "sv": "och att inte av", "fi": "ja ei että oli",
    "pl": "się nie jest oraz", "cs": "že jsou byl při", "hu": "az egy és hogy", "tr": "bir ve için ile",
    "id": "yang dan dengan untuk", "vi": "và của là không",
}
_LATIN_OF = {word: name for name, words in reversed(LATIN.items()) for word in words.split()}
KANA = re.compile(r"[ぁ-ヿ]")
THAI = re.compile(r"[ก-\u0e3a]")


def latin_group(text: str) -> str:
    """The group of a text in Latin script: L with the language most of its short words are of."""
    n = Counter(map(_LATIN_OF.get, text.split()))
    n.pop(None, None)
    if not n:
        return "L"
    return "L" + max(LATIN, key=lambda name: n[name])


def quoted(text: str, begin: int, end: int, first: bool, last: bool) -> list[tuple[int, int]]:
    """Stretches of a block inside quotation marks, outermost ones only."""
    out, stack = [], []
    for m in QUOTE.finditer(text, begin, end):
        ch, at = m.group(), m.start()
        if ch == '"':
            after = text[at + 1] if at + 1 < end else " "
            before = text[at - 1] if at > begin else " "
            if stack and stack[-1][0] == '"':
                opening = False
            else:
                opening = not (not before.isspace() and before not in "(（[“«" and (after.isspace() or after in ".,;:!?)"))
        elif ch == "“":
            opening = not (stack and stack[-1][0] == "„")
        else:
            opening = ch in PAIRS
        if opening:
            stack.append((ch, at))
        elif stack:
            ch0, at0 = stack.pop()
            if not stack:
                out.append((at0, at))
        elif first:
            out = [(begin - 1, at)]
    if stack and last:
        out.append((stack[0][1], end + 1))
    return out


def within(stretches: list[tuple[int, int]], at: int) -> bool:
    """Whether a position lies in one of the stretches, which are in order and apart."""
    i = bisect_left(stretches, (at,)) - 1
    return i >= 0 and at <= stretches[i][1]


def events(text: str) -> list[tuple]:
    """Events in order: (position after mark and closers, group, left context, shape,
    left context with the word before, next word, is it evidence).

    The end of a block is an event whose next word is BLOCK_END; without an end
    mark its group is None. The end of the text itself is no evidence, since the
    text may be cut anywhere.
    """
    out: list[tuple] = []
    size = len(text)
    latin = latin_group(text)
    east = "K" if KANA.search(text) else "H"
    quotes = QUOTE.search(text) is not None
    thai = THAI.search(text) is not None
    breaks = [m.span() for m in BLANK.finditer(text)]
    breaks.append((size, size))
    b = 0
    common = latin
    for n, (stop, following) in enumerate(breaks):
        raw = text[b:stop]
        e = b + len(raw.rstrip())
        b += len(raw) - len(raw.lstrip())
        if b < e:
            inside = quoted(text, b, e, n == 0, n == len(breaks) - 1) if quotes and QUOTE.search(text, b, e) else ()
            found = []
            for m in MARK.finditer(text, b, e):
                start, p = m.span()
                run = m.group()
                if run[-1] in HIDDEN:
                    run = run.translate(ZERO_WIDTH)
                if p < e:
                    nxt = text[p]
                    if nxt.isspace():
                        token = text[p : p + 40].split(None, 1)
                        right = right_key(token[0]) if token else "-"
                    elif not EAST.isdisjoint(run) or "…" in run and NO_SPACE_NEXT.match(nxt):
                        right = right_key(nxt)
                    else:
                        continue
                    if inside and within(inside, p):
                        continue
                else:
                    right = BLOCK_END
                at = max(text.rfind(" ", b, start), text.rfind("\n", b, start), b - 1, start - 48) + 1
                group, left, shape, two = left_key(text[at:start], run)
                if run[0] in "。！？｡" or "。" in run or group in ("H", "K"):
                    group = east
                elif group is None:
                    group = common
                elif group == "L":
                    group = latin
                common = group
                if two is not None:
                    before = max(text.rfind(" ", b, at - 1), text.rfind("\n", b, at - 1), b - 1) + 1 if at > b else at
                    word = text[before : at - 1] if at > b else BLOCK_START
                    two = f"{clean(word) if word != BLOCK_START else word}|{two}" if len(word) <= 12 else None
                found.append((p, group, left, shape, two, right, True))
            if thai:
                gaps = [
                    (m.start(), "T", " ", " ", None, right_key(text[m.end() : m.end() + 40].split(None, 1)[0]), True)
                    for m in THAI_GAP.finditer(text, b, e)
                    if not (inside and within(inside, m.start()))
                ]
                if gaps:
                    found = sorted(found + gaps)
            if not found or found[-1][0] < e:
                if script(text[e - 1]) == "T":
                    found.append((e, "T", " ", " ", None, BLOCK_END, True))
                else:
                    found.append((e, None, "", "", None, BLOCK_END, True))
            if n == len(breaks) - 1:
                found[-1] = (*found[-1][:6], False)
            out.extend(found)
        b = following
    return out


#: A capitalised word after a word without a mark.
MID = re.compile(r" (?<=[^.!?…:;”\"»)\]|] )([^\W\d_a-z][^\W\d_]+)")
MIDDLE = "^"
#: The first word of a block that begins in Thai.
THAI_START = re.compile(r"(?:^|\n\s*\n)\s*([ก-\u0e3aเ-\u0e4e]\S*)")


COUNT_DDL = "grp string, left string, right string, shape string, n long"


def count_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, row_key, text) -> counts of (group, left context, next word)."""
    total: Counter = Counter()

    def flush():
        keys = list(total)
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([k[j] for k in part], pa.string()) for j in range(4)), pa.array([total[k] for k in part], pa.int64())],
                names=["grp", "left", "right", "shape", "n"],
            )
        total.clear()

    for batch in batches:
        middle: Counter = Counter()
        for text in batch.column(2).to_pylist():
            if not text:
                continue
            middle.update(MID.findall(text))
            for _, group, left, shape, two, right, evidence in events(text):
                if group is not None and evidence:
                    total[(group, left, right, shape)] += 1
                    if two is not None:
                        total[(group, two, right, left)] += 1
            if THAI.search(text):
                for m in THAI_START.finditer(text):
                    total[(BLOCK_START, "T", right_key(m.group(1)), "")] += 1
        for word, n in middle.items():
            if word[0].isupper():
                total[(MIDDLE, "", word, "")] += n
        if len(total) > 500_000:
            yield from flush()
    yield from flush()


def weights(left: str) -> tuple[float, float]:
    word = left.rstrip(").~")
    return (WORD_PRIOR, WORD_SMOOTH) if len(word) > 3 and word.isalpha() else (PRIOR, SMOOTH)


def after_word(left: str) -> bool:
    """Whether a left context is a word of four letters or more with a full stop."""
    return len(left) > 4 and left[-1] == "." and left[:-1].isalpha()


class Model:
    """theta: share of boundaries after a left context; starts: next words after a
    boundary, by group; others: next words after no boundary, by left context."""

    #: A word that stands capitalised after marks only begins a sentence there.
    STARTER = 30.0

    def __init__(self, theta, starts, others, common, rights=frozenset(), starters=frozenset(), single: float = 0.02):
        self.theta, self.starts, self.others, self.common, self.single = theta, starts, others, common, single
        self.rights, self.starters = rights, starters
        self.memo: dict = {}

    def parts(self) -> tuple:
        """What a worker makes the same model of."""
        return self.theta, self.starts, self.others, self.common, self.rights, self.starters

    def odds(self, group: str, left: str, shape: str, two: str | None, right: str) -> tuple[float, float]:
        """(share of boundaries, likelihood ratio of the next word)."""
        asked = (group, left, shape, two, right)
        memo = self.memo.get(asked)
        if memo is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            for key in (two, left, shape + "~", shape + "*", "*"):
                theta = self.theta.get((group, key)) if key is not None else None
                if theta is not None:
                    break
            else:
                theta, key = (0.95 if any(c in left for c in STRONG) else 0.5), "*"
            starter = right in self.starters and after_word(left)
            if right not in self.rights:
                right = _coarse(right)
            start = self.starts.get(group, {})
            yes = start.get(right) or start.get(_coarse(right)) or 1e-4
            own = self.others.get((group, key))
            common = self.common.get(group, {})
            base = common.get(right) or common.get(_coarse(right)) or 1e-4
            smooth = weights(key)[1]
            no = (own[1].get(right, 0.0) + smooth * base) / (own[0] + smooth) if own else base
            memo = (theta, yes / max(no, 1e-9))
            if starter:
                memo = (max(theta, 0.5), max(memo[1], self.STARTER))
            self.memo[asked] = memo
        return memo

    def boundaries(self, text: str) -> list[int]:
        """The end of every sentence of a text."""
        out: list[int] = []
        found = events(text)
        i, n = 0, len(found)
        while i < n:
            x = found[i]
            if x[5] is BLOCK_END:
                out.append(x[0])
                i += 1
                continue
            j = i + 1
            # a run: each event lies right after the single word that follows the one before
            while j < n and found[j][0] - found[j - 1][0] < 14 and found[j][5] is not BLOCK_END and " " not in text[found[j - 1][0] : found[j][0]].strip():
                j += 1
            if j == i + 1:
                theta, ratio = self.odds(*x[1:6])
                if theta * ratio > 1 - theta:
                    out.append(x[0])
            else:
                for y, post in zip(found[i:j], self.posteriors([y[1:6] for y in found[i:j]])):
                    if post > 0.5:
                        out.append(y[0])
            i = j
        return out

    def posteriors(self, run: list[tuple]) -> list[float]:
        """Forward-backward over a run of events; after a boundary, another one needs a
        sentence of a single word."""
        scores = [self.odds(*x) for x in run]
        if len(run) == 1:
            theta, ratio = scores[0]
            return [theta * ratio / (theta * ratio + 1 - theta)]
        step = []
        for k, (theta, ratio) in enumerate(scores):
            after = theta * (self.single if k and run[k][1] not in (" ",) and run[k][1][0] not in STRONG else 1.0)
            # rows: event before (none, boundary); columns: this event
            step.append(((1 - theta, theta * ratio), (1 - after, after * ratio)))
        forward = [(1.0, 0.0)]
        for t in step:
            a, b = forward[-1]
            x, y = a * t[0][0] + b * t[1][0], a * t[0][1] + b * t[1][1]
            s = x + y or 1.0
            forward.append((x / s, y / s))
        back = [(1.0, 1.0)]
        for t in reversed(step):
            c, d = back[-1]
            x, y = t[0][0] * c + t[0][1] * d, t[1][0] * c + t[1][1] * d
            s = max(x, y) or 1.0
            back.append((x / s, y / s))
        back.reverse()
        out = []
        for (a, b), (c, d) in zip(forward[1:], back[1:]):
            yes, no = b * d, a * c
            out.append(yes / (yes + no) if yes + no else 0.0)
        return out


def _coarse(right: str) -> str:
    """The shape of a next word that the model has no entry for."""
    if right in (BLOCK_END, "-", "#", "“", "(", "¿", "¡") or not right[0].isalpha():
        return right
    kind = script(right[0])
    if kind in "HTADK":
        return kind
    return kind + ("x" if right[0].islower() else "X")


def fit(rows: list[tuple[str, str, str, float]], shape_of: dict[tuple[str, str], str], rights=frozenset(), starters=frozenset(), barred=frozenset()) -> Model:
    """Expectation maximisation over (group, left, right, count); shapes are left
    contexts whose name ends in '*'."""
    by: dict[tuple[str, str], dict[str, float]] = defaultdict(lambda: defaultdict(float))
    groups: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for group, left, right, n in rows:
        by[(group, left)][right] += n
    for (group, left), r in list(by.items()):
        if left.endswith("*") and left != "*":
            for k, n in r.items():
                by[(group, "*")][k] += n
    total = {k: sum(r.values()) for k, r in by.items()}
    # a first guess of the share of boundaries at block ends: the highest that a common context has
    top: dict[str, float] = {}
    for group in {g for g, _ in by}:
        ratios = sorted(
            ((r.get(BLOCK_END, 0.0) / total[k], total[k]) for k, r in by.items() if k[0] == group and not k[1].endswith("*") and "|" not in k[1]),
            reverse=True,
        )
        mass, all_mass, rho = 0.0, sum(n for _, n in ratios), 0.0
        for ratio, n in ratios:
            mass += n
            rho = ratio
            if mass >= 0.35 * all_mass:
                break
        top[group] = max(rho, 0.02)
    theta = {}
    for key, r in by.items():
        guess = r.get(BLOCK_END, 0.0) / total[key] / top[key[0]]
        theta[key] = min(0.98, max(0.02, (guess * total[key] + 0.5 * PRIOR) / (total[key] + PRIOR)))
    starts: dict[str, dict[str, float]] = {}
    common: dict[str, dict[str, float]] = {}
    others: dict[tuple[str, str], tuple[float, dict[str, float]]] = {}
    for _ in range(ROUNDS):
        yes: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        no: dict[tuple[str, str], dict[str, float]] = {}
        share = {}
        for key, r in by.items():
            group, left = key
            smooth = weights(left)[1]
            start, base, own = starts.get(group), common.get(group), others.get(key)
            t, got = theta[key], 0.0
            rest: dict[str, float] = {}
            for right, n in r.items():
                if right == BLOCK_END:
                    p = 1.0
                elif (group, right) in barred:
                    p = 0.0
                elif right in starters and (after_word(left) or left == "xl.*"):
                    p = 0.97
                elif start is None:
                    p = t
                    if right[-1] == "x" or right[0].islower():
                        p = t * 0.2
                else:
                    a = t * max(start.get(right, 0.0), 1e-5)
                    q = max(base.get(right, 0.0), 1e-5)
                    if own:
                        q = (own[1].get(right, 0.0) + smooth * q) / (own[0] + smooth)
                    p = a / (a + (1 - t) * q)
                got += p * n
                rest[right] = (1 - p) * n
                if left.endswith("*") and left != "*":
                    yes[group][right] += p * n
            no[key] = rest
            share[key] = got
        for group, r in yes.items():
            s = sum(r.values())
            starts[group] = {k: n / s for k, n in r.items()}
            for k in list(starts[group]):
                starts[group].setdefault(_coarse(k), 0.0)
        gather: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        for (group, left), r in no.items():
            if left.endswith("*") and left != "*":
                for k, n in r.items():
                    gather[group][k] += n
                    if _coarse(k) != k:
                        gather[group][_coarse(k)] += 0.05 * n
        for group, r in gather.items():
            s = sum(r.values()) + 1e-9
            common[group] = {k: n / s for k, n in r.items()}
        others = {k: (sum(r.values()), r) for k, r in no.items()}
        for key in by:
            group, left = key
            shape = shape_of.get(key)
            if left == "*":
                theta[key] = min(0.999, max(0.001, share[key] / total[key]))
                continue
            up = theta.get((group, shape)) if shape else None
            up = theta.get((group, "*"), 0.5) if up is None else up
            prior = weights(left)[0]
            theta[key] = min(0.999, max(0.001, (share[key] + prior * up) / (total[key] + prior)))
    return Model(theta, starts, others, common, frozenset(rights), frozenset(starters))


#: Share of all events, and the least count, that give a next word an entry.
RIGHT_SHARE, RIGHT_LEAST = 5e-6, 20


def train(rows: DataFrame, share: float = SHARE, least: int = LEAST, right_share: float = RIGHT_SHARE) -> Model:
    """Count on all texts; the driver gets the entries of at most 1 / ``share`` left
    contexts a group, at most 1 / ``right_share`` next words, and the shapes of the rest."""
    counts = staged(
        rows.select("kind", "row_key", "text")
        .mapInArrow(count_events, COUNT_DDL)
        .groupBy("grp", "left", "right", "shape")
        .agg(F.sum("n").alias("n"))
    )
    plain = counts.filter(~F.col("grp").isin(MIDDLE, BLOCK_START))
    middle = counts.filter(F.col("grp") == MIDDLE).groupBy("right").agg(F.sum("n").alias("middle"))
    begins = counts.filter(F.col("grp") == BLOCK_START).groupBy(F.col("left").alias("grp"), "right").agg(F.sum("n").alias("begins"))
    single = plain.filter(~F.col("left").contains("|"))
    totals = staged(single.groupBy("grp").agg(F.sum("n").alias("total")))  # one row a group
    every = totals.agg(F.sum("total")).first()[0] or 0
    words = (
        single.groupBy("grp", "right")
        .agg(F.sum("n").alias("n"))
        .join(begins, ["grp", "right"], "left")
        .groupBy("right")
        .agg(F.sum("n").alias("n"), F.sum("begins").alias("begins"), F.max(F.col("grp") == "T").alias("thai"))
        .filter(F.col("n") >= max(RIGHT_LEAST, right_share * every))
        .join(middle, "right", "left")
    )
    words = staged(words)
    known, starters, barred = set(), set(), set()
    for r in words.collect():
        word, n = r["right"], r["n"]
        if r["thai"]:
            if (r["begins"] or 0) < 0.02 * n:
                barred.add(("T", word))
                known.add(word)
        elif (r["middle"] or 0) <= 0.005 * n and len(word) > 1 and word[0].isupper() and word.isalpha() and script(word[0]) in "LCG" and word not in SHAPES:
            starters.add(word)
            known.add(word)
        elif len(word) <= 4:
            known.add(word)
    barred.discard(("T", BLOCK_END))
    kept = staged(
        plain.groupBy("grp", "left")
        .agg(F.sum("n").alias("all"), F.max_by("shape", "n").alias("shape"))
        .join(F.broadcast(totals), "grp")
        .filter(F.col("all") >= F.greatest(F.lit(float(least)), share * F.col("total")))
        .drop("total")
    )
    listed = rows.sparkSession.createDataFrame([(w,) for w in sorted(known)] or [("",)], "right string").withColumn("own", F.lit(True))
    first = F.substring("right", 1, 1)
    upper = first != F.lower(first)
    # words without an entry are sent as one of two examples, from which the shape follows
    pooled = plain.join(F.broadcast(listed), "right", "left").withColumn(
        "right",
        F.when(F.col("own") | (F.col("right") == BLOCK_END) | (F.length("right") < 2), F.col("right"))
        .when(first.rlike(r"^\p{Lu}$") & upper, F.concat(first, F.lit("?")))
        .otherwise(F.col("right")),
    )
    named = (
        pooled.join(F.broadcast(kept.select("grp", "left")), ["grp", "left"])
        .groupBy("grp", "left", "right")
        .agg(F.sum("n").alias("n"))
    )
    shapes = (
        pooled.filter(~F.col("left").contains("|"))
        .groupBy("grp", F.concat("shape", F.lit("*")).alias("left"), "right")
        .agg(F.sum("n").alias("n"))
    )
    # words without an entry back off to what such words do, not to the common ones of their shape
    rare = (
        pooled.filter(~F.col("left").contains("|"))
        .join(F.broadcast(kept.select("grp", "left")), ["grp", "left"], "left_anti")
        .groupBy("grp", F.concat("shape", F.lit("~")).alias("left"), "right")
        .agg(F.sum("n").alias("n"))
    )
    data: Counter = Counter()
    for group, left, right, n in named.unionByName(shapes).unionByName(rare).select("grp", "left", "right", "n").collect():
        data[(group, left, right if right in known or right == BLOCK_END else _coarse(right))] += n
    shape_of = {}
    for r in kept.collect():
        shape_of[(r["grp"], r["left"])] = r["shape"] + ("" if "|" in r["left"] else "*")
    for group, left, _ in data:
        if left.endswith("~"):
            shape_of[(group, left)] = left[:-1] + "*"
    return fit([(*k, n) for k, n in data.items()], shape_of, known, starters, barred)


#: Next-word classes that look like words.
SHAPES = frozenset({"LX", "CX", "GX", "Lx", "Cx", "Gx", "LxX", "CxX", "GxX", "H", "T", "A", "D", "K"})


FOUND_DDL = "kind string, row_key long, sentence_index long, char_start long, char_end long"


def cut(model: Model):
    parts = model.parts()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*parts)
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                out = [[] for _ in range(5)]
                for kind, key, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    if not text or text.isspace():
                        continue
                    ends = own.boundaries(text)
                    n, at0 = len(ends), 0
                    for e in ends:
                        while text[at0].isspace():
                            at0 += 1
                        out[3].append(at0)
                        at0 = e
                    out[0].extend([kind] * n)
                    out[1].extend([key] * n)
                    out[2].extend(range(n))
                    out[4].extend(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:])],
                    names=["kind", "row_key", "sentence_index", "char_start", "char_end"],
                )

    return run


def sentences(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """Offsets of every sentence of the rows (kind, row_key, text)."""
    rows = rows.select("kind", "row_key", "text")
    return rows.mapInArrow(cut(model or train(rows)), FOUND_DDL)
