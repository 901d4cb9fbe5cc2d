"""Personal data: overlapping candidates by pattern, judged by boosted trees, redacted above calibrated thresholds.

Built-in functions only. Base spans follow fixed rules and always stay. Further spans are proposed
by patterns that are meant to find too much; trees score each by its format and its context. They are
taught by the proposals in written examples and by those in the documents that another pattern
confirms or contradicts; neither the example's answer nor the other pattern is an input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webfurrow.functions.binding import bind
from webfurrow.llm.common import without

# The base patterns. The look-behind only keeps a scan from retrying inside a run that
# has failed from its start; possessive repeats cannot change what matches, as what follows is not in them.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without a match of these has no span of the kind; a cheap test before the exact one.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# Generators of further candidates, by kind, with a cheap test before. None bounds a length. A
# secret's candidate is what follows its name and sign.
_WORD = "[A-Za-z0-9-]"
GENERATORS = {
    "email": (rf"(?i)(?<![{_LOCAL}])[A-Za-z0-9][{_LOCAL}]*+\s*+[\[(]\s*+at\s*+[\])]\s*+{_WORD}++"
              rf"(?:(?:\s*+[\[(]\s*+dot\s*+[\])]\s*+|\.){_WORD}++)++", r"(?i)[\[(]\s*+at\s*+[\])]"),
    "ip": (r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]*+(?::[0-9A-Fa-f]*+){2,}+(?![0-9A-Za-z])", r"[0-9A-Fa-f]:[0-9A-Fa-f:]"),
    "card": (r"(?<![0-9A-Za-z.-])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{3,6})++(?![0-9A-Za-z])", r"[0-9]{4}[ ./_-]{1,2}[0-9]{3}"),
    "phone": (r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{2,4}(?:[ .-][0-9]{2,4})++(?![0-9A-Za-z])",
              r"[0-9]{2,4}\)?[ .-]{1,2}[0-9]{2,4}[ .-][0-9]"),
    "secret": (r"(?i)(?<![A-Za-z])(?:token|passw(?:or)?d|passphrase|secret|pwd|api[_ -]?key|access[_ -]?key)\s*+[=:]\s*+[\"']?"
               r"[A-Za-z0-9_/+.~-]{6,}+", r"(?i)(?:token|passw(?:or)?d|passphrase|secret|pwd|key)\s*+[=:]"),
}
_SECRET_NAME = r"(?i)^[^=:]*[=:]\s*+[\"']?"
KINDS = [*BASE, "secret"]

# Words near a candidate that speak for a kind, and words that speak against it.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address|from|to)\b", "ip": r"(?i)\b(?:ip|host|server|addr|address|ping|node|from)\b",
    "card": r"(?i)\b(?:card|visa|master|mastercard|amex|credit|debit|karte|tarjeta|carte|pay)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile?|fax|contact|whatsapp|ruf|rufen|m[oó]vil|cell|dial|text)\b",
    "secret": r"(?i)\b(?:my|your|login|user|use|set|export|with|credentials?)\b",
}
AGAINST = {
    "email": r"(?i)\b(?:see|note|look|meet|meeting|price|version|stand|open|sold|page|chapter|start)\b",
    "ip": r"(?i)\b(?:at|time|until|start|score|ratio|verse|lap|clock|mac)\b",
    "card": r"(?i)\b(?:order|isbn|serial|ref|item|invoice|part|model|page|sku|tracking|version|case)\b",
    "phone": r"(?i)\b(?:page|pages|order|isbn|index|item|invoice|room|figure|lines?|years?|between|version|part|score|case|ref|rows?)\b",
    "secret": r"(?i)\b(?:type|kind|field|no|missing|invalid|wrong|error|of|column|param)\b",
}
CONTEXT = 24
_TOP_LEVEL = r"(?i)[.\])]\s*(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|it|at|ch|nl)$"

#: Size of the trained model: trees of depth two, shrunk.
TREES, RATE = 24, 0.3
#: A threshold keeps the candidates of a kind that the held-out fold shows to be right this often.
PRECISION = 0.95
#: Weight of all examples of one answer, and of all proposals of one answer in the documents, whatever their number.
EXAMPLES_WEIGHT, DOCUMENTS_WEIGHT = 1000.0, 200.0
FEATURES = ["digits", "length", "marks", "groups", "classes", "shape", "cue", "against", "sign", "quote", "edge", "start"]
#: Items of an array that are put together at a time.
CHUNK = 128

_SPANS = "array<struct<start:int,stop:int,found:string>>"


def scan(items: Column, state: Column, step: Callable[[Column, Column], Column], made: str) -> Column:
    """Goes once over ``items``. ``step(state, item)`` gives a struct of the new ``state`` and an array ``out`` (of type ``made``);
    what the steps give out is one array. Arrays grow by ``CHUNK`` items before they are put together,
    so the work stays in proportion to the items."""
    none = F.expr(f"cast(array() as {made})")

    def one(at: Column, item: Column) -> Column:
        taken = step(at["state"], item)
        return F.struct(taken["state"].alias("state"), F.concat(at["out"], taken["out"]).alias("out"))

    def whole(every: Column) -> Column:
        def chunk(total: Column, first: Column) -> Column:
            return F.aggregate(
                F.slice(every, first, F.lit(CHUNK)), F.struct(total["state"].alias("state"), none.alias("out")), one,
                lambda at: F.struct(at["state"].alias("state"), F.concat(total["parts"], F.array(at["out"])).alias("parts")))

        starts = F.when(F.size(every) > 0, F.sequence(F.lit(1), F.size(every), F.lit(CHUNK))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.aggregate(starts, F.struct(state.alias("state"), F.expr(f"cast(array() as array<{made}>)").alias("parts")), chunk,
                           lambda total: F.flatten(total["parts"]))

    return bind(items, whole)  # worked out once, though it is cut many times


def matches(text: Column, pattern: str, hint: str) -> Column:
    """``start, stop, found`` of the leftmost, non-overlapping matches, in code points.

    The pieces between the matches and the matches themselves follow each other, so their lengths give the places.
    """
    pairs = F.filter(F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")),
        lambda p: p["found"].isNotNull())

    def step(at: Column, pair: Column) -> Column:
        start = at + F.char_length(pair["gap"])
        stop = start + F.char_length(pair["found"])
        return F.struct(stop.alias("state"), F.array(F.struct(
            start.alias("start"), stop.alias("stop"), pair["found"].alias("found"))).alias("out"))

    return F.when(text.rlike(hint), scan(pairs, F.lit(0), step, _SPANS)).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digit sum with every second digit from the right doubled is divisible by ten."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, 1).cast("int")
        doubled = F.when((n - i) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return total + doubled

    # A longer number is no card, so its sum is not needed.
    return F.when((n >= 13) & (n <= 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(digits_of(found))
    if kind == "phone":
        return F.length(digits_of(found)).between(9, 15)
    return F.lit(True)


def candidate_features(text: Column, kind: str, span: Column) -> Column:
    """Small whole numbers, each below ten, that describe a candidate and what stands before and after it."""
    found, start, stop = span["found"], span["start"], span["stop"]
    n = F.length(digits_of(found))
    ahead = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
    behind = F.substring(text, stop + 1, 1)
    one = lambda condition: F.when(condition, 1).otherwise(0)
    shape = {"email": one(found.rlike(_TOP_LEVEL)) + one(found.rlike(r"(?i)dot")), "card": one(found.rlike("^[3-6]")) + one(n.between(13, 19)),
             "ip": one(found.rlike("[A-Fa-f]")) + one(found.rlike("^[0-9]{1,2}:[0-9]{2}(?::|$)")) * 2,
             "phone": one(found.rlike(r"^\(|^0")) + one(found.rlike(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$")) * 2,
             "secret": one(found.rlike("[0-9]")) + one(found.rlike("[A-Za-z]")) + one(found.rlike("[a-z]") & found.rlike("[A-Z]"))}[kind]
    return F.struct(
        F.least(F.floor(n / 2.5), F.lit(9)).cast("int").alias("digits"),
        F.least(F.floor(F.char_length(found) / 4), F.lit(9)).cast("int").alias("length"),
        F.least(F.length(F.regexp_replace(found, "[A-Za-z0-9]", "")), F.lit(5)).cast("int").alias("marks"),
        F.least(F.regexp_count(found, F.lit("[A-Za-z0-9]++")), F.lit(9)).cast("int").alias("groups"),
        (one(found.rlike("[0-9]")) + 2 * one(found.rlike("[a-z]")) + 4 * one(found.rlike("[A-Z]"))).alias("classes"),
        shape.alias("shape"), one(ahead.rlike(CUES[kind])).alias("cue"), one(ahead.rlike(AGAINST[kind])).alias("against"),
        (one(ahead.rlike(r"[:=]\s*[\"']?$")) + one(ahead.rlike(r"=\s*[\"']?$"))).alias("sign"), one(ahead.rlike("[\"'(<]$")).alias("quote"),
        one(behind.rlike("[A-Za-z0-9]")).alias("edge"), one(ahead.rlike(r"(?:^|[\r\n])\s*$")).alias("start"))


def proposals(text: Column, kind: str) -> Column:
    """Further candidates of a kind."""
    spans = matches(text, *GENERATORS[kind])
    if kind == "secret":  # the span is what follows the name and the sign
        spans = F.transform(spans, lambda s: F.struct(
            (s["stop"] - F.char_length(F.regexp_replace(s["found"], _SECRET_NAME, ""))).cast("int").alias("start"), s["stop"].alias("stop"),
            F.regexp_replace(s["found"], _SECRET_NAME, "").alias("found")))
    return spans


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(matches(text, BASE[kind], HINT[kind]), lambda s: valid(kind, s["found"]))


# ---- examples

# What stands before a candidate, and candidates; every one before every other gives an example.
_PLACES = ["555 123 44", "(555) 123-4567", "555-123-4567", "555.123.4567", "030 1234 5678", "06 12 34 56 78", "123-456-789", "(030) 123 456"]
_LONG_PLACES = ["(555) 123-4567", "555-123-4567", "555.123.4567", "(212) 555-0188"]
_CARDS = ["4111.1111.1111.1111", "4111/1111/1111/1111", "5500_0000_0000_0004", "3782-822463-10005", "4012 8888 8888 1882"]
_HIDDEN = ["jane [at] mail [dot] org", "j.doe (at) example.com", "info[at]shop[dot]de", "max_m (at) web (dot) fr", "sales [at] shop.co.uk",
           "a-b [AT] host [DOT] net", "k99 [at] lab.institute [dot] edu"]
_PERHAPS = ["kim [at] lab.institute", "pat [at] north.office", "lee (at) team.group", "jo [at] desk.four", "note [at] chapter.seven"]
_NOT_HIDDEN = ["note [at] chapter.seven", "meeting (at) noon.today", "stand [at] platform.nine", "price (at) 5.99", "v2 [at] 3.1",
               "look [at] figure.two", "them (at) start.line"]
_LINKS = ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "2001:0db8:85a3:0:0:8a2e:370:7334", "::1:2"]
_CLOCKS = ["12:30:45", "08:15:00", "1:2:3", "10:20:30:40"]
_SECRETS = ["hunter2", "abc123XYZ", "9f86d081884c7d659a2f", "correct-horse-battery", "S3cretPass", "k3y_v4lue", "eyJhbGciOi.J9xQ.Zz0", "Tr0ub4dor"]
_PLAIN = ["required", "missing", "optional", "string", "incorrect", "unknown", "expired", "protected"]
EXAMPLES = {
    "phone": ([(["tel ", "tel: ", "phone: ", "call me at ", "mobile ", "fax ", "whatsapp ", "you can dial ", "contact: ", "my cell: "], _PLACES),
               (["", "ask for the ", "and ", "we are open, ", "she said "], _LONG_PLACES)],
              [(["page ", "pages ", "order ", "isbn ", "index ", "item ", "invoice ", "room ", "see figure ", "lines ", "years ", "part "],
                [*_PLACES, "2020 12 3456 7890", "10 20 30 40"]),
               (["", "and ", "of ", "the "], ["555 123 44", "123-456-789", "10 20 30 40", "12 34 56 78 90 12 34 56 78 90 12", "2020 12 3456 7890"])]),
    "email": ([(["mail ", "e-mail: ", "contact ", "write to ", "reach me: ", "", "or ", "and "], _HIDDEN),
               (["mail ", "e-mail: ", "contact ", "write to ", "address: "], _PERHAPS)],
              [(["see ", "please look, ", "the meeting: ", "we stand, ", "open ", "", "and "], _NOT_HIDDEN),
               (["see ", "look, ", "meet ", "open ", "note: ", "", "and ", "the ", "with "], _PERHAPS)]),
    "card": ([(["card ", "card no: ", "visa ", "mastercard: ", "pay with ", "my credit card is "], _CARDS), (["", "and "], _CARDS[:2])],
             [(["order ", "serial ", "ref ", "item ", "invoice: ", "part ", "model ", "tracking "], [*_CARDS, "1234 567 890", "2020 1234 5678"]),
              (["", "and ", "of "], ["1234 567 890", "2020/123/456", "1999-2000-2001", "8000 1234 567 8901 2345"])]),
    "ip": ([(["ip ", "host: ", "server ", "ping ", "address: ", "node ", "", "and "], _LINKS)],
           [(["at ", "time: ", "until ", "start ", "score ", "lap ", "", "and "], _CLOCKS), (["mac ", "ratio "], ["1:2:3", "00:1b:44:11:3a:b7"])]),
    "secret": ([(["password: ", "passwd=", "token = \"", "secret: ", "my api_key='", "use access key: ", "set pwd=", "passphrase: ", "login with password: "], _SECRETS),
                (["password = \"", "my passphrase='", "export SECRET='"], ["letmein", "opensesame", "trustnoone"])],
               [(["password: ", "no password: ", "token: ", "type of token: ", "secret: ", "invalid passphrase: ", "field api key: ", "access key: "], _PLAIN),
                (["missing token: ", "type of token = ", "wrong password = "], [*_PLAIN, "12.0.1", "json.object"])]),
}


def examples(spark: SparkSession) -> DataFrame:
    """``kind, right, text, fold``: the written examples."""
    array = lambda values: F.array(*map(F.lit, values))
    groups = [F.struct(F.lit(kind).alias("kind"), F.lit(right).alias("right"), array(befores).alias("befores"), array(values).alias("values"))
              for kind, (good, bad) in EXAMPLES.items() for right, pairs in ((True, good), (False, bad)) for befores, values in pairs]
    rows = spark.range(1).select(F.inline(F.array(*groups)))
    # One generator a step: Spark takes none inside another expression.
    rows = rows.withColumn("before", F.explode("befores")).withColumn("value", F.explode("values"))
    rows = rows.withColumn("after", F.explode(array(["", " today", ".\nNext"]))).select("kind", "right", F.concat("before", "value", "after").alias("text"))
    return rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(4)))


# ---- training

def meets(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["stop"]) & (span["start"] < o["stop"]))


def _described(kind: str, right: Callable[[Column], Column]):
    """Column function of a span: its kind, features and answer."""
    return lambda s: F.struct(F.lit(kind).alias("kind"), candidate_features(F.col("_t"), kind, s).alias("x"), right(s).alias("right"))


def training_counts(docs: DataFrame, text: str = "text") -> list:
    """How often each description occurs, by source, kind, answer and fold.

    A written example is right or wrong for its kind. In the documents, all of which teach, a proposal is
    right if it covers part of a valid base span of its kind, and wrong if it covers part of one of
    another kind; others teach nothing. The counts are grouped by features, so their number is bounded by the
    feature space however many documents there are.
    """
    found = lambda given, right: F.concat(*[F.transform(
        proposals(F.col("_t"), kind), _described(kind, right(kind))) for kind in GENERATORS if given(kind)])
    base = {kind: base_spans(F.col("_t"), kind) for kind in BASE}

    def confirmed(kind: str):
        own = base.get(kind, F.expr(f"cast(array() as {_SPANS})"))
        other = F.concat(*[b for k, b in base.items() if k != kind])
        return lambda s: F.when(meets(s, own), True).when(meets(s, other), False)

    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    candidate = F.lit(False)
    for _, hint in GENERATORS.values():
        candidate = candidate | F.col("_t").rlike(hint)
    of_docs = (docs.select(content.alias("_t")).filter(candidate).select(
        F.pmod(F.xxhash64("_t"), F.lit(4)).alias("fold"), F.explode(found(lambda kind: True, confirmed)).alias("c"))
        .filter("c.right IS NOT NULL").select(F.lit(0).alias("source"), "fold", "c.kind", "c.x", "c.right"))
    written = examples(docs.sparkSession).withColumnRenamed("text", "_t")
    of_examples = written.select("fold", "kind", "right", F.explode(found(lambda kind: True, lambda kind: lambda s: F.lit(None).cast("boolean"))).alias("c")) \
        .filter("c.kind = kind").select(F.lit(1).alias("source"), "fold", "kind", "c.x", "right")
    return (of_docs.unionByName(of_examples).groupBy("source", "kind", "x", "right", (F.col("fold") == 0).alias("held"))
            .agg(F.count("*").alias("n")).orderBy("source", "kind", "x", "right", "held").collect())


class Boosted:
    """Trees of depth two on features of one candidate: the first split, then one split on either side.

    ``slope`` and ``shift`` turn a score into the share of right candidates with it, for comparing kinds.
    """

    def __init__(self, bias: float, trees: list, threshold: float, slope: float = 1.0, shift: float = 0.0):
        self.bias, self.trees, self.threshold, self.slope, self.shift = bias, trees, threshold, slope, shift

    def score(self, x: dict) -> float:
        total = self.bias
        for feature, cut, low, high in self.trees:
            side = low if x[feature] < cut else high
            total += side[2] if x[side[0]] < side[1] else side[3]
        return total

    def sql(self, x: str) -> str:
        """The same score as an expression over a struct of features."""
        def leaf(side):
            return f"CASE WHEN {x}.{side[0]} < {side[1]} THEN {side[2]!r}D ELSE {side[3]!r}D END"

        return " + ".join([f"{self.bias!r}D"] + [f"CASE WHEN {x}.{feature} < {cut} THEN {leaf(low)} ELSE {leaf(high)} END"
                                                 for feature, cut, low, high in self.trees])

    def splits(self) -> set[str]:
        """Features that some tree really cuts."""
        return {f for feature, cut, low, high in self.trees for f, c in ((feature, cut), (low[0], low[1]), (high[0], high[1])) if c > 0}


def _split(rows: list[tuple[dict, float, float]]) -> tuple[float, str, int, float, float]:
    """Best single split: gain, feature, cut and the two leaf values (a Newton step each)."""
    def value(g: float, h: float) -> tuple[float, float]:
        return g * g / (h + 1.0), RATE * g / (h + 1.0)

    all_g, all_h = sum(g for _, g, _ in rows), sum(h for _, _, h in rows)
    best = (0.0, FEATURES[0], 0, value(all_g, all_h)[1], value(all_g, all_h)[1])
    for feature in FEATURES:
        for cut in sorted({x[feature] for x, _, _ in rows})[1:]:
            g, h = sum(g for x, g, _ in rows if x[feature] < cut), sum(h for x, _, h in rows if x[feature] < cut)
            (low, low_leaf), (high, high_leaf) = value(g, h), value(all_g - g, all_h - h)
            gain = low + high - value(all_g, all_h)[0]
            if gain > best[0] + 1e-9:
                best = (gain, feature, cut, low_leaf, high_leaf)
    return best


def _calibrate(judged: Sequence[tuple[float, bool, float]]) -> tuple[float, float]:
    """Slope and shift of the logistic curve from scores to answers: a few damped Newton steps."""
    slope, shift = 1.0, 0.0
    for _ in range(50):
        g = [0.0, 0.0]
        h = [1e-3, 0.0, 1e-3]
        for score, right, n in judged:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * score + shift))))
            for k, z in enumerate((score, 1.0)):
                g[k] += n * (right - p) * z
            w = n * p * (1 - p)
            h[0] += w * score * score
            h[1] += w * score
            h[2] += w
        g[0] -= 1e-3 * (slope - 1)
        det = h[0] * h[2] - h[1] * h[1]
        if det <= 1e-12:
            break
        slope += max(-0.5, min(0.5, (h[2] * g[0] - h[1] * g[1]) / det))
        shift += max(-0.5, min(0.5, (h[0] * g[1] - h[1] * g[0]) / det))
    return max(slope, 1e-3), shift


def boost(counts: Sequence[tuple[dict, bool, float]], held: Sequence[tuple[dict, bool, float]]) -> Boosted:
    """Gradient boosting of the logistic loss on weighted descriptions, calibrated on the held-out ones.

    The threshold is the lowest score from which on held-out candidates are right ``PRECISION`` of the
    time. Without an example of either answer nothing is learned and nothing passes.
    """
    good, bad = sum(n for _, right, n in counts if right), sum(n for _, right, n in counts if not right)
    if not good:
        return Boosted(0.0, [], math.inf)
    bias = math.log((good + 1) / (bad + 1))
    model = Boosted(bias, [], 0.0)
    scores = [bias] * len(counts)
    for _ in range(TREES):
        rows = []
        for (x, right, n), score in zip(counts, scores, strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
            rows.append((x, n * ((1.0 if right else 0.0) - p), n * p * (1 - p)))
        _, feature, cut, *_ = _split(rows)
        sides = []
        for part in ([r for r in rows if r[0][feature] < cut], [r for r in rows if r[0][feature] >= cut]):
            _, f, c, low, high = _split(part)
            sides.append((f, c, low, high))
        model.trees.append((feature, cut, *sides))
        one = Boosted(0.0, model.trees[-1:], 0.0)
        scores = [s + one.score(x) for s, (x, _, _) in zip(scores, counts, strict=True)]
    judged = sorted(((model.score(x), right, n) for x, right, n in (held or counts)), key=lambda j: -j[0])
    threshold, right_n, all_n = math.inf, 0.0, 0.0
    for i, (score, right, n) in enumerate(judged):
        all_n, right_n = all_n + n, right_n + n * right
        if right_n >= PRECISION * all_n and (i + 1 == len(judged) or judged[i + 1][0] < score):
            threshold = score - 1e-9
    model.threshold = threshold
    model.slope, model.shift = _calibrate(judged)
    return model


def train(docs: DataFrame, text: str = "text") -> dict[str, Boosted]:
    """One model per kind, learned from the examples and from all documents."""
    counts = [(r["source"], r["kind"], r["x"].asDict(), r["right"], r["held"], r["n"]) for r in training_counts(docs, text)]
    totals: dict[tuple, int] = {}
    for source, kind, _, right, _, n in counts:
        totals[source, kind, right] = totals.get((source, kind, right), 0) + n
    by_kind: dict[str, tuple[list, list]] = {kind: ([], []) for kind in KINDS}
    for source, kind, x, right, held, n in counts:
        weight = (EXAMPLES_WEIGHT if source else DOCUMENTS_WEIGHT) * n / totals[source, kind, right]
        by_kind[kind][1 if held else 0].append((x, right, weight))
    return {kind: boost(*parts) for kind, parts in by_kind.items()}


# ---- use

OUTPUT = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
_KINDED = "array<struct<kind:string,start:int,stop:int,odds:double>>"


def _passing(kind: str, model: Boosted) -> str:
    """Of the described proposals of a kind (column ``_x_`` and the kind), those whose score reaches the threshold, with
    their calibrated log odds."""
    scored = (f"transform(_x_{kind}, s -> struct('{kind}' AS kind, s.start AS start, s.stop AS stop, {model.sql('s.x')} AS odds))")
    return (f"transform(filter({scored}, s -> s.odds >= {model.threshold!r}D), s -> struct(s.kind AS kind, s.start AS start, s.stop AS stop, "
            f"s.odds * {model.slope!r}D + {model.shift!r}D AS odds))")


def settled(spans: Column) -> Column:
    """Spans of which no two overlap, but for base spans (no odds), which all stay.

    The spans are gone through by start and fall into chains, each of which reaches over the starts of its
    members. In a chain base spans are taken first, then the others from the highest odds down, unless they
    overlap one taken before.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["odds"].alias("odds"))))
    kind = "array<struct<start:int,stop:int,kind:string,odds:double>>"
    none = F.expr(f"cast(array() as {kind})")
    # One more span beyond all closes the last chain.
    closed = F.concat(ordered, F.expr(f"cast(array(named_struct('start', 2147483647, 'stop', 2147483647, 'kind', '', 'odds', 0.0D)) as {kind})"))

    def best(chain: Column) -> Column:
        ranked = F.array_sort(F.transform(F.filter(chain, lambda s: s["odds"].isNotNull()), lambda s: F.struct(
            (-s["odds"]).alias("rank"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["odds"].alias("odds"))))
        return F.aggregate(ranked, F.filter(chain, lambda s: s["odds"].isNull()), lambda kept, s: F.when(meets(s, kept), kept).otherwise(
            F.concat(kept, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["odds"].alias("odds"))))))

    def step(at: Column, s: Column) -> Column:
        apart = s["start"] >= at["reach"]
        out = F.when(apart, F.when(F.size(at["chain"]) > 1, best(at["chain"])).otherwise(at["chain"])).otherwise(none)
        chain = F.when(apart, F.array(s)).otherwise(F.concat(at["chain"], F.array(s)))
        return F.struct(F.struct(F.greatest(at["reach"], s["stop"]).alias("reach"), chain.alias("chain")).alias("state"), out.alias("out"))

    return scan(closed, F.struct(F.lit(0).alias("reach"), none.alias("chain")), step, kind)


def _with_features(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), candidate_features(F.col("_t"), kind, s).alias("x"))


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def _with_spans(docs: DataFrame, models: dict[str, Boosted], text: str) -> DataFrame:
    """Adds ``_t``, ``_base`` (one array per kind) and ``_all`` (kind, start, stop; in order of kind and start)."""
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    named = lambda spans, kind: F.transform(spans, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(None).cast("double").alias("odds")))
    df = docs.withColumn("_t", content)
    df = df.withColumn("_base", F.struct(*[named(base_spans(F.col("_t"), k), k).alias(k) for k in BASE]))
    used = [kind for kind in GENERATORS if not math.isinf(models[kind].threshold)]
    df = df.withColumns({f"_x_{kind}": F.transform(proposals(F.col("_t"), kind), _with_features(kind)) for kind in used})
    df = df.withColumn("_found", F.concat(*[F.expr(_passing(kind, models[kind])) for kind in used], F.expr(f"cast(array() as {_KINDED})")))
    every = F.concat(*[F.col("_base")[k] for k in BASE], "_found")
    # Base spans of different kinds may overlap; there is something to settle only with proposals.
    df = df.withColumn("_taken", F.when(F.size("_found") > 0, F.transform(settled(every), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))).otherwise(
        F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))))
    of_kind = [F.array_sort(F.filter("_taken", _is_kind(kind))) for kind in KINDS]
    return df.withColumn("_all", F.concat(*of_kind))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def find_pii(docs: DataFrame, models: dict[str, Boosted], text: str = "text") -> DataFrame:
    """Adds counts of base spans by kind, the digest of the base spans and all spans as text.

    Base spans are found per kind from left to right without overlap, and a match that fails its
    rule is dropped without retry. A further span is added if its score reaches its kind's threshold and it
    overlaps no base span and no added span of higher calibrated odds. Null counts as empty: no spans, the digest of nothing.
    Nothing is shuffled; existing columns of the added names are replaced.
    """
    kept = without(docs, OUTPUT)
    df = _with_spans(kept, models, text)
    return df.select(*[F.col(f"`{c}`") for c in kept.columns],
                     *[F.size(F.col("_base")[k]).cast("bigint").alias(f"n_{k}") for k in BASE],
                     F.sha2(_joined(F.concat(*[F.col("_base")[k] for k in BASE])), 256).alias("base_sha256"),
                     _joined(F.col("_all")).alias("spans"))


def redact(docs: DataFrame, models: dict[str, Boosted], text: str = "text") -> DataFrame:
    """Replaces every span of ``text`` by its kind in brackets; overlapping spans become one mark.

    The mark is of the span that starts first (the longer one, then the first kind by name, on a tie).
    Texts without spans, null among them, stay as they are. Write the result before other expressions
    on its text: Spark would put this one in the place of each mention of the column.
    """
    df = _with_spans(docs, models, text)
    order = F.array_sort(F.transform("_all", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["kind"].alias("kind"))))

    no_text = F.expr("cast(array() as array<string>)")

    def marked(spans: Column) -> Column:
        def chunk(total: Column, first: Column) -> Column:
            """Some spans at a time, against the stretch of text they lie in, since finding a place in a text takes steps."""
            part = F.slice(spans, first, F.lit(CHUNK))
            reach = F.greatest(total["at"], F.array_max(F.transform(part, lambda s: -s["back"])))
            stretch = F.substring(F.col("_t"), total["at"] + 1, reach - total["at"])

            def add(state: Column, s: Column) -> Column:
                gap = s["start"] - state["at"]
                mark = F.concat(F.substring(state["stretch"], state["at"] - total["at"] + 1, gap), F.lit("["), F.upper(s["kind"]), F.lit("]"))
                return F.struct(state["stretch"].alias("stretch"), F.greatest(state["at"], -s["back"]).alias("at"),
                                F.when(gap >= 0, F.concat(state["out"], F.array(mark))).otherwise(state["out"]).alias("out"))

            return F.aggregate(
                part, F.struct(stretch.alias("stretch"), total["at"].alias("at"), no_text.alias("out")), add,
                lambda state: F.struct(state["at"].alias("at"), F.concat(total["out"], F.array(F.array_join(state["out"], ""))).alias("out")))

        return F.aggregate(
            F.sequence(F.lit(1), F.size(spans), F.lit(CHUNK)), F.struct(F.lit(0).cast("int").alias("at"), no_text.alias("out")), chunk,
            lambda end: F.concat(F.array_join(end["out"], ""), F.substring(F.col("_t"), end["at"] + 1, F.char_length("_t"))))

    clean = bind(order, marked)
    column = F.when(F.size("_all") > 0, clean).otherwise(F.col(f"`{text}`"))
    return df.withColumn(text, column).select(*[F.col(f"`{c}`") for c in docs.columns])
