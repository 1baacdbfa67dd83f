"""Secret scan in DataFrame operations only: exact patterns, and a battery of randomness tests for other tokens.

The patterns give the base spans (assignments, access keys, hexadecimal runs), which always stay. Beside them every
token of 20 characters or more that mixes digits and letters is a candidate. Its encoding is inferred as the smallest
alphabet that holds it; under the hypothesis that it is drawn at random from that alphabet three tests are made:

* uniformity: chi-squared of the letter counts, as a normal deviate (Wilson and Hilferty),
* runs: how often neighbours lie on different sides of the alphabet's middle,
* serial correlation of neighbouring letters' places in the alphabet.

The smallest of the three p-values is corrected for their number. Random tokens then have uniform p-values and
structured ones (names, words, counters) small ones. Short tokens leave the tests little power, so the share of
structured tokens is estimated per encoding and length class from the p-values of the whole corpus: those above one
half tell how many are random. A class's tokens are accepted above the smallest cut at which the share of structured
tokens among the accepted is not shown, by ``DEVIATIONS`` standard deviations, to be over ``share``. So large classes
keep the rate and random tokens of small classes are not lost; but in a class of some tens of tokens, too few to show
it, the share of structured ones can be several times ``share`` (15 tokens over the lowest cut and 5 over one half are
taken whole, an estimated third of them structured). Tokens of letters or of digits only are no candidates, and those
with the signs of both base64 alphabets fit no encoding. The table of counts has at most 8 encodings times 31
length classes times 9 cuts, whatever the size of the input; only it is collected.

Defined cases: a null text is the empty text and has no spans. Texts are read whole. Repeated rows are judged alike,
though each counts in the estimate. Only the named columns are read and returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.session import stored

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# maximal runs of at least the least length: the same spans as all runs, the short ones dropped
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
LEAST_GROUP = 8

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Encodings from the smallest alphabet to the largest: name and letters in order.
ENCODINGS = (
    ("hex", DIGITS + LOWER[:6]),
    ("upper_hex", DIGITS + UPPER[:6]),
    ("base32", UPPER + DIGITS[2:8]),
    ("lower36", DIGITS + LOWER),
    ("upper36", DIGITS + UPPER),
    ("base62", DIGITS + UPPER + LOWER),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64_url", UPPER + LOWER + DIGITS + "-_"),
)
NEAR_CLASSES = 2  # length classes on either side, an octave together
NEAR_TOKENS = 50  # tokens that they count for at most
DEVIATIONS = 2.0
CUTS = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches of a pattern, left to right: array of (start, end, found), code points, ``found`` being the group.

    The texts between matches and the matches themselves alternate, so their lengths add up to the places.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    items = F.zip_with(
        F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.char_length).alias("size")),
        found,
        lambda p, f: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), f.alias("found")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out"))

    def follow(state, item):
        begin = state["at"] + item["gap"]
        end = begin + item["size"]
        one = F.struct(begin.alias("start"), end.alias("end"), item["found"].alias("found"))
        # the last gap has no match after it
        return F.when(
            item["size"].isNotNull(), F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))
        ).otherwise(state)

    return F.aggregate(items, start, follow, lambda state: state["out"])


def _named(spans: Column, kind: str) -> Column:
    return F.transform(
        spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )


def base_spans(text: Column) -> Column:
    """array of (kind, start, end): the exact patterns."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    assign = F.filter(places(text, ASSIGN, 2), lambda s: F.char_length(s["found"]) >= LEAST_GROUP)
    # cheap tests first: most texts hold no mark of an assignment and no key
    return F.concat(
        F.when(text.contains(":") | text.contains("="), _named(assign, "assign")).otherwise(none),
        F.when(text.contains("AKIA"), _named(places(text, ACCESS), "access")).otherwise(none),
        F.when(text.rlike(HEX), _named(places(text, HEX), "hex")).otherwise(none),
    )


def _upper_tail(z: Column) -> Column:
    """Probability that a normal deviate exceeds z (logistic form, error below 0.0002)."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * z + F.lit(0.070566) * z * z * z))


def _battery(token: Column, alphabet: str) -> Column:
    """Combined p-value of the three tests for a token of the alphabet."""
    m = len(alphabet)
    n = F.char_length(token).cast("double")
    letters = F.split(token, "")
    squares = F.aggregate(
        F.transform(
            F.array_distinct(letters),
            lambda c: F.pow((F.char_length(token) - F.char_length(F.replace(token, c, F.lit("")))).cast("double"), 2),
        ),
        F.lit(0.0),
        lambda total, x: total + x,
    )
    freedom = float(m - 1)
    chi = squares * m / n - n
    uniform = (F.pow(F.greatest(chi, F.lit(0.0)) / freedom, 1 / 3) - (1 - 2 / (9 * freedom))) / (2 / (9 * freedom)) ** 0.5
    middle, spread = (m - 1) / 2, ((m * m - 1) / 12) ** 0.5
    numbers = F.transform(letters, lambda c: (F.instr(F.lit(alphabet), c) - 1 - F.lit(middle)) / spread)

    def neighbours(u):
        pairs = F.zip_with(F.slice(u, F.lit(1), F.size(u) - 1), F.slice(u, F.lit(2), F.size(u) - 1), lambda a, b: a * b)
        changes = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + (x < 0).cast("double"))
        products = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
        runs = F.abs(changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        serial = F.abs(products) / F.sqrt(n - 1)
        return F.least(F.lit(1.0), 2 * _upper_tail(F.greatest(runs, serial)))

    smallest = F.least(_upper_tail(uniform), bound(numbers, neighbours))
    return 1 - F.pow(1 - smallest, 3)


def candidates(text: Column) -> Column:
    """array of (start, end, encoding, size_class, p) of the tokens that mix digits and letters."""
    empty = F.array().cast("array<struct<start:int,end:int,encoding:string,size_class:int,p:double>>")
    tokens = F.filter(places(text, TOKEN), lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[A-Za-z]"))

    def tested(s):
        token = F.regexp_replace(s["found"], "=+$", "")
        name = p = None
        for encoding, alphabet in ENCODINGS:
            within = token.rlike("^[" + alphabet.replace("-", "\\-") + "]+$")
            name = F.when(within, encoding) if name is None else name.when(within, encoding)
            p = F.when(within, _battery(token, alphabet)) if p is None else p.when(within, _battery(token, alphabet))
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            # letters of both base64 alphabets fit no encoding; such tokens are paths and names
            F.coalesce(name, F.lit("none")).alias("encoding"),
            F.floor(F.log2(F.char_length(token).cast("double")) * 2).cast("int").alias("size_class"),
            F.coalesce(p, F.lit(0.0)).alias("p"),
        )

    return F.when(text.rlike("[0-9]"), F.transform(tokens, tested)).otherwise(empty)


def chosen_cut(own: list[int], near: list[int], share: float) -> float:
    """The smallest cut of a class, by its numbers of tokens over each cut and those of its neighbours.

    The neighbours count for at most ``NEAR_TOKENS`` tokens. A cut is too low where the tokens between it and one half
    exceed, by ``DEVIATIONS`` standard deviations, what random tokens leave there and ``share`` allows.
    """
    weight = min(1.0, NEAR_TOKENS / near[0]) if near[0] else 0.0
    for i, cut in enumerate(CUTS[:-1]):
        fraction = (CUTS[-1] - cut) / (1 - CUTS[-1])
        random_ones = own[-1] + weight * near[-1]
        accepted = own[i] + weight * near[i]
        between = accepted - random_ones
        noise = (own[i] - own[-1]) + weight**2 * (near[i] - near[-1])
        noise += fraction**2 * (own[-1] + weight**2 * near[-1])
        if between - fraction * random_ones - DEVIATIONS * noise**0.5 <= share * accepted:
            return cut
    return CUTS[-1]


def _cuts(tested: DataFrame, share: float) -> Column:
    """Map of "encoding/size_class" to the p-value above which its tokens are accepted."""
    rows = tested.select(F.explode("tested").alias("t")).select("t.*")
    counts = (
        rows.groupBy("encoding", "size_class")
        .agg(*(F.sum((F.col("p") > cut).cast("long")).alias(f"over{i}") for i, cut in enumerate(CUTS)))
        .collect()
    )
    over = {(r.encoding, r.size_class): [r[f"over{i}"] for i in range(len(CUTS))] for r in counts}
    cuts = {}
    for (encoding, size), own in over.items():
        others = [n for (e, z), n in over.items() if e == encoding and 0 < abs(z - size) <= NEAR_CLASSES]
        near = [sum(n) for n in zip(*others)] or [0] * len(CUTS)
        cuts[f"{encoding}/{size}"] = chosen_cut(own, near, share)
    pairs = [x for name, cut in sorted(cuts.items()) for x in (F.lit(name), F.lit(cut))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")


def spans(docs: DataFrame, key: str, text: str, share: float = 0.05) -> DataFrame:
    """(key, base, added) per row: arrays of (kind, start, end) in code points."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    # written once: the estimate needs every token before the first verdict
    scanned = stored(
        rows.select(F.col(key), base_spans(F.col("__text")).alias("base"), candidates(F.col("__text")).alias("tested")),
        "secrets",
    )
    cut = _cuts(scanned, share)

    def is_new(s):
        over = cut[F.concat_ws("/", s["encoding"], s["size_class"])]
        clear = ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.coalesce(s["p"] > over, F.lit(False)) & clear

    return scanned.select(key, "base", _named(F.filter("tested", is_new), "random").alias("added"))
