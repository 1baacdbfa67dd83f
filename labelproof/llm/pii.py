"""Personal data: exact patterns, and a semi-Markov conditional random field that finds what they miss.

The patterns give the base spans (e-mail, IP address, card, phone), which always stay. The model reads islands: runs of
neighbouring words that each hold a digit or an at sign, or lie in an address whose at sign is written out ("[at]",
"(at)", "at" before a domain, whose dots may be written out too). It scores whole candidate segments of up to ``LONGEST`` words
by features of the segment as one piece (numbers of digits, groups, separators, check digit, the word before it), and
a dynamic program over the segments chooses borders and kinds together. Segments that the model prefers over none by
``margin`` (in log odds), and that touch no base span, are added.

The model is trained here, on at most ``islands_per_row`` islands of each of at most ``sample_rows`` rows: in turn those
with a base span of each kind and those with a digit, an at sign or the word "at" but none, by hashed id. They are
labelled by the patterns. A third of the labelled islands are written in a form the patterns do
not know (without plus, with dots for spaces, with "at" for the sign), so that it learns shapes beyond theirs.

Defined cases: a null text is the empty text and has no spans. Texts are read whole, in time linear in their length.
Without training rows nothing is added. Repeated rows are judged alike, and other columns are not read.
An empty table gives no rows. A span of more than ``LONGEST`` words (a number in seven groups) is not found whole.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.llm.batches import bounded
from labelproof.session import stored

KINDS = ("email", "ip", "card", "phone")
NONE = 0  # label of words outside segments; the kinds follow from 1
LABELS = len(KINDS) + 1
LONGEST = 6
WIDTH = 1 << 11

SIGNAL = re.compile(r"[0-9@]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number is tried at its first digit only: a later start fails for the same reason
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\s]+")
# a written-out at sign: in brackets, or as a word of its own; and the domain after it, its dots written out or not
WRITTEN_AT = re.compile(r"(?i)(?<=[\s\[({<])at(?=[\s\])}>])")
WRITTEN_DOMAIN = re.compile(
    r"(?i)[A-Za-z0-9-]++(?:(?:\.|[^\S\n]*+[\[({<][^\S\n]*+dot[^\S\n]*+[\])}>][^\S\n]*+|[^\S\n]++dot[^\S\n]++)[A-Za-z0-9-]++)+"
)
BLANKS = re.compile(r"[^\S\n]*+")
CLOSING = {"[": "]", "(": ")", "{": "}", "<": ">"}
ROWS_WITH_SIGNAL = r"[0-9@]|(?i:[\s\[({<]at[\s\])}>])"


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        value = int(d) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, done))
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, leftmost and not overlapping per kind, by start and kind."""
    if not text or not SIGNAL.search(text):
        return []
    spans = [("email", a, b) for a, b in emails(text)]
    for m in ADDRESS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(digits := only_digits(m.group())) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 10 <= len(only_digits(m.group())) <= 15:
            spans.append(("phone", *m.span()))
    return ordered(spans)


def ordered(spans):
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A word without the punctuation around it; brackets stay where they have a partner inside."""
    while start < end and text[start] in "\"'<[{,;:!?.*=&$#":
        start += 1
    while start < end and text[end - 1] in "\"'>]},;:!?.*=&$#":
        end -= 1
    if start < end and text[start] == "(" and text.find(")", start, end) < 0:
        start += 1
    if start < end and text[end - 1] == ")" and text.find("(", start, end) < 0:
        end -= 1
    return start, end


def written_addresses(text: str) -> list[tuple[int, int]]:
    """Places that may be e-mail addresses with the at sign written out, on one line: from local part to domain."""
    out, done = [], 0
    for m in WRITTEN_AT.finditer(text):
        start, end = m.span()
        left = start
        while left > done and text[left - 1] != "\n" and text[left - 1].isspace():
            left -= 1
        after = BLANKS.match(text, end).end()
        if left > done and text[left - 1] in CLOSING and text[after : after + 1] == CLOSING[text[left - 1]]:
            left, after = left - 1, BLANKS.match(text, after + 1).end()
            while left > done and text[left - 1] != "\n" and text[left - 1].isspace():
                left -= 1
        elif left == start or after == end:
            continue
        local = left
        while local > done and LOCAL.match(text, local - 1):
            local -= 1
        domain = WRITTEN_DOMAIN.match(text, after) if local < left else None
        if domain:
            done = domain.end()
            out.append((local, done))
    return out


def islands(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """(word before in lower case, words) of every run of words on one line that hold a digit or an at sign, or lie in
    an address whose at sign is written out."""
    out: list[tuple[str, list[tuple[int, int]]]] = []
    written = written_addresses(text) if text else []
    if not text or not (written or SIGNAL.search(text)):
        return out
    before, words, last, place = "", [], 0, 0
    for m in WORD.finditer(text):
        start, end = m.span()
        if words and text.find("\n", last, start) >= 0:
            out.append((before, words))
            words, before = [], ""
        while place < len(written) and written[place][1] <= start:
            place += 1
        if SIGNAL.search(text, start, end) or (place < len(written) and written[place][0] < end):
            start, end = trimmed(text, start, end)
            if start < end:
                words.append((start, end))
        else:
            if words:
                out.append((before, words))
                words = []
            before = m.group().lower()[-12:]
        last = m.end()
    if words:
        out.append((before, words))
    return out


def bucket(n: int) -> int:
    return n if n <= 20 else 21


def features(segment: str, before: str, words: int) -> list[int]:
    """Numbers of the features of a whole segment."""
    digits = only_digits(segment)
    groups = re.findall(r"[0-9]+", segment)
    letters = sum(c.isalpha() for c in segment)
    at, dots = segment.count("@"), segment.count(".")
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]", "0", segment)))
    names = [
        f"digits={bucket(len(digits))}",
        f"groups={min(len(groups), 6)}:{','.join(str(bucket(len(g))) for g in groups[:5])}",
        f"letters={min(letters, 3)}",
        f"at={min(at, 2)}:dots_after={min(segment[segment.find('@') :].count('.'), 2) if at else -1}",
        f"dots={min(dots, 4)}:groups={min(len(groups), 6)}",
        f"plus={segment[:1] == '+'}:digits={9 < len(digits) < 16}",
        f"brackets={'(' in segment}",
        f"words={words}",
        f"shape={shape[:24]}",
        f"check={13 < len(digits) < 20 and letters == 0 and luhn(digits)}",
        f"parts={len(groups) == 4 and dots == 3 and all(len(g) < 4 and int(g) < 256 for g in groups)}:{letters == 0}",
        f"first={segment[:1].isdigit()}:last={segment[-1:].isdigit()}",
        f"before={before}",
        "bias",
    ]
    return [zlib.crc32(n.encode()) % WIDTH for n in names]


class SemiMarkovModel:
    """Segment weights (label, feature) and transitions (label before, label)."""

    def __init__(self):
        self.weights = np.zeros((LABELS, WIDTH))
        self.steps = np.zeros((LABELS + 1, LABELS))  # the last row starts an island

    def lattice(self, text: str, before: str, words: list[tuple[int, int]]):
        return list(self.columns(text, before, words))

    def columns(self, text: str, before: str, words: list[tuple[int, int]]):
        """Per end and length: feature numbers and label scores; several words cannot be outside a segment."""
        for end in range(1, len(words) + 1):
            row = []
            for size in range(1, min(LONGEST, end) + 1):
                first = end - size
                ahead = before if first == 0 else "#"
                numbers = features(text[words[first][0] : words[end - 1][1]], ahead, size)
                scores = self.weights[:, numbers].sum(axis=1)
                if size > 1:
                    scores[NONE] = -np.inf
                row.append((numbers, scores))
            yield row

    def best(self, text: str, before: str, words: list[tuple[int, int]]) -> list[tuple[int, int, int, float]]:
        """(first word, end word, label, log odds over no segment) of the best segmentation.

        A column of the lattice goes once it is used; about a hundred bytes a word stay.
        """
        n = len(words)
        value = np.full((n + 1, LABELS + 1), -np.inf)
        value[0, LABELS] = 0.0
        sizes, previous = np.zeros((n + 1, LABELS), np.int8), np.zeros((n + 1, LABELS), np.int8)
        gains, outside = np.zeros((n + 1, LABELS)), np.zeros(n)
        for end, row in enumerate(self.columns(text, before, words), 1):
            outside[end - 1] = row[0][1][NONE]
            for size, (_, scores) in enumerate(row, 1):
                ways = value[end - size, :, None] + self.steps
                best = ways.argmax(axis=0)
                total = ways[best, range(LABELS)] + scores
                none = sum(outside[end - size : end])
                for label in range(LABELS):
                    if total[label] > value[end, label]:
                        value[end, label] = total[label]
                        sizes[end, label], previous[end, label], gains[end, label] = size, best[label], scores[label] - none
        out, end = [], n
        label = int(value[n, :LABELS].argmax())
        while end > 0:
            size = int(sizes[end, label])
            if label != NONE:
                out.append((end - size, end, label, float(gains[end, label])))
            end, label = end - size, int(previous[end, label])
        return out[::-1]

    def learn(self, text, before, words, gold: list[tuple[int, int, int]], rate: float) -> None:
        """One gradient step on the log probability of the gold segmentation."""
        rows = self.lattice(text, before, words)
        n = len(rows)
        forward = np.full((n + 1, LABELS + 1), -np.inf)
        forward[0, LABELS] = 0.0
        arrive = {}
        for end in range(1, n + 1):
            for size, (_, scores) in enumerate(rows[end - 1], 1):
                into = np.logaddexp.reduce(forward[end - size, :, None] + self.steps, axis=0) + scores
                arrive[end, size] = into
                forward[end, :LABELS] = np.logaddexp(forward[end, :LABELS], into)
        backward = np.full((n + 1, LABELS + 1), -np.inf)
        backward[n, :LABELS] = 0.0
        for end in range(n, 0, -1):
            for size, (_, scores) in enumerate(rows[end - 1], 1):
                onward = scores + backward[end, :LABELS]
                reach = np.logaddexp.reduce(self.steps + onward[None, :], axis=1)
                backward[end - size] = np.logaddexp(backward[end - size], reach)
        total = np.logaddexp.reduce(forward[n, :LABELS])
        chosen = {(end, end - first): label for first, end, label in gold}
        inside = {k for first, end, _ in gold for k in range(first, end)}
        chosen.update({(k + 1, 1): NONE for k in range(n) if k not in inside})
        step_change = np.zeros_like(self.steps)
        for (end, size), into in arrive.items():
            numbers, scores = rows[end - 1][size - 1]
            change = -np.exp(into + backward[end, :LABELS] - total)
            pairs = forward[end - size, :, None] + self.steps + (scores + backward[end, :LABELS])[None, :]
            step_change -= np.exp(pairs - total)
            if (end, size) in chosen:
                change[chosen[end, size]] += 1.0
            for label in range(LABELS):
                self.weights[label, numbers] += rate * change[label]
        previous = LABELS
        for end, size in sorted(chosen):
            step_change[previous, chosen[end, size]] += 1.0
            previous = chosen[end, size]
        self.steps += rate * step_change


def disguised(kind: str, found: str, rng: random.Random) -> str:
    """The same item in a form the patterns do not know."""
    if kind == "email":
        local, _, domain = found.partition("@")
        if rng.random() < 0.5:
            domain = domain.replace(".", rng.choice(["[dot]", "(dot)", " dot ", " [dot] "]))
        return local + rng.choice(["[at]", "(at)", " at ", " [at] ", " (at) "]) + domain
    if kind == "phone":
        return rng.choice([found.lstrip("+"), found.replace(" ", ".").lstrip("+"), "00" + found.lstrip("+")])
    if kind == "card":
        digits = only_digits(found)
        return rng.choice([".", "/"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return found.replace(".", rng.choice(["[.]", "-"]))


def example(text: str, before: str, words: list[tuple[int, int]]):
    """An island as (text, before, words, gold), its gold segments being the base spans that fit its words."""
    gold = []
    for kind, a, b in base_spans(text):
        first = next((i for i, w in enumerate(words) if w[0] <= a < w[1]), None)
        end = next((i + 1 for i, w in enumerate(words) if w[0] < b <= w[1]), None)
        if first is not None and end is not None and 0 < end - first <= LONGEST and (not gold or gold[-1][1] <= first):
            gold.append((first, end, KINDS.index(kind) + 1))
    return text, before, words, gold


def sampled_islands(value: str, islands_per_row: int) -> list[tuple[str, str, list[tuple[int, int]]]]:
    """(island, word before, words) of at most so many islands of a text, chosen by hash, those with a base span first.

    Of an island longer than any segment by far, a stretch around its first base span is cut out, or one by hash.
    """
    spans = sorted((a, b) for _, a, b in base_spans(value))
    starts = [a for a, _ in spans]
    reach = list(accumulate((b for _, b in spans), max))

    def touched(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return before > 0 and reach[before - 1] > start

    ranked = []
    for number, (before, words) in enumerate(islands(value)):
        draw = zlib.crc32(f"{number}:{value[words[0][0] : words[0][1]]}".encode("utf-8", "replace"))
        held = touched(words[0][0], words[-1][1])
        ranked.append((not held, draw, number, before, words))
    # the islands without a base span keep half of the places, if there are so many
    ranked.sort(key=lambda r: r[:3])
    labelled = [r for r in ranked if not r[0]]
    others = ranked[len(labelled) :]
    room = max(islands_per_row - len(others), islands_per_row - islands_per_row // 2)
    out = []
    for bare, draw, number, before, words in [*labelled[:room], *others][:islands_per_row]:
        spare = len(words) - 4 * LONGEST
        if spare > 0:
            first = draw % (spare + 1)
            if not bare:
                first = next((k for k, w in enumerate(words) if touched(*w)), first) - draw % LONGEST
            first = min(max(first, 0), spare)
            before, words = before if first == 0 else "#", words[first : first + 4 * LONGEST]
        start, end = words[0][0], words[-1][1]
        out.append((value[start:end], before, [(a - start, b - start) for a, b in words]))
    return out


def sampled_ids(signal: DataFrame, sample_rows: int) -> list:
    """Ids of rows with a base span of each kind and of rows without one, in turn, by their hashes."""
    kind_of_id = signal.schema["id"]

    def marked(batches):
        for batch in batches:
            kinds = [sorted({k for k, _, _ in base_spans(v)}) or ["none"] for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kinds, pa.list_(pa.string()))], ["id", "kinds"]
            )

    schema = T.StructType([kind_of_id, T.StructField("kinds", T.ArrayType(T.StringType()))])
    rows = stored(bounded(signal).mapInArrow(marked, schema), "pii-kinds").filter(F.col("id").isNotNull())
    strata = []
    for kind in (*KINDS, "none"):
        own = rows.filter(F.array_contains("kinds", kind)).select("id", F.xxhash64("id").alias("draw"))
        strata.append([r.id for r in own.orderBy("draw", "id").limit(sample_rows).collect()])
    chosen: dict = {}
    queues = [iter(s) for s in strata]
    while queues and len(chosen) < sample_rows:
        for queue in list(queues):
            fresh = next((i for i in queue if i not in chosen), None)
            if fresh is None:
                queues.remove(queue)
            elif len(chosen) < sample_rows:
                chosen[fresh] = True
    return list(chosen)


def fit(
    docs: DataFrame, key: str, text: str, sample_rows: int = 1500, epochs: int = 4, seed: int = 11, islands_per_row: int = 50
):
    """A model from the islands of a bounded sample of rows; None where no row holds a base span."""
    signal = docs.filter(F.col(text).rlike(ROWS_WITH_SIGNAL)).select(F.col(key).alias("id"), F.col(text).alias("text"))
    known = sampled_ids(signal, sample_rows)
    if not known:
        return None

    def found(batches):
        for batch in batches:
            rows = []
            for value in batch.column(0).to_pylist():
                for island, before, words in sampled_islands(value, islands_per_row):
                    rows.append((island, before, ",".join(f"{a}:{b}" for a, b in words)))
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["island", "before", "words"])

    sample = signal.filter(F.col("id").isin(known)).select("text")
    cut = bounded(sample).mapInArrow(found, "island string, before string, words string").collect()
    rng = random.Random(seed)
    examples = []
    for row in sorted(cut):
        words = [tuple(map(int, w.split(":"))) for w in row.words.split(",")]
        examples.append(example(row.island, row.before, words))
        gold = examples[-1][3]
        if len(gold) == 1 and gold[0][:2] == (0, len(words)) and rng.random() < 1 / 3:
            other = disguised(KINDS[gold[0][2] - 1], row.island, rng)
            parts = [trimmed(other, *m.span()) for m in WORD.finditer(other)]
            if parts and len(parts) <= LONGEST and all(a < b for a, b in parts):
                examples.append((other, row.before, parts, [(0, len(parts), gold[0][2])]))
    if not any(e[3] for e in examples):
        return None
    model = SemiMarkovModel()
    for epoch in range(epochs):
        rng.shuffle(examples)
        for e in examples:
            model.learn(*e, rate=0.2 / (1 + epoch))
    return model


def added_spans(text: str, base, model: SemiMarkovModel, margin: float) -> list[tuple[str, int, int]]:
    out = []
    for before, words in islands(text):
        if all(any(a < end and start < b for _, a, b in base) for start, end in words):
            continue
        for first, end, label, odds in model.best(text, before, words):
            start, stop = words[first][0], words[end - 1][1]
            if odds >= margin and not any(a < stop and start < b for _, a, b in base):
                out.append((KINDS[label - 1], start, stop))
    return out


SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)
ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def spans(docs: DataFrame, keys: list[str], text: str, model: SemiMarkovModel | None, margin: float = 2.0) -> DataFrame:
    """(keys, base, added) per row: arrays of (kind, start, end) in code points, by start and kind."""
    fields = [*(docs.schema[k] for k in keys), T.StructField("base", T.ArrayType(SPAN)), T.StructField("added", T.ArrayType(SPAN))]

    def run(batches):
        for batch in batches:
            base, added = [], []
            for value in batch.column(0).to_pylist():
                own = base_spans(value) if value else []
                more = added_spans(value, own, model, margin) if value and model is not None else []
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                added.append([{"kind": k, "start": a, "end": b} for k, a, b in ordered(more)])
            columns = [pa.array(c, pa.list_(ARROW_SPAN)) for c in (base, added)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*keys, "base", "added"])

    return bounded(docs.select(F.col(text).alias("__text"), *keys)).mapInArrow(run, T.StructType(fields))
