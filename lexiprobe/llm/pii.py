"""Personal data: base patterns, and candidate spans that boosted trees select.

Everything that touches documents is DataFrame functions; nothing is exploded or shuffled.

1. Base spans: e-mail addresses, IPv4 addresses, card numbers that pass the Luhn test and phone
   numbers in international form. They always stay.
2. High-recall generators propose further, overlapping spans: e-mail addresses in words, national
   phone numbers, cards in other spellings, IPv6 addresses, and keys and access tokens.
3. Gradient-boosted trees over format and context features score each candidate. They are fitted on
   candidates that templates write (a fixed number of rows, made and measured by the same column
   functions). Thresholds come from whole templates that the trees did not see: for each generator
   the lowest score from which on those are right to the wanted share.
4. A candidate is added if it reaches its threshold and overlaps no base span. Candidates of several
   generators may overlap; a redaction masks their union.

Work grows with the length of a text and the number n of its matches as n log n: places are running
sums, overlaps one sweep in order, and context is what stands between matches.

Defined results
---------------
* A null text counts as empty; it has no spans. Rows with a null doc_id and repeated rows are
  searched like others. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so
  further columns may have any name.
* Offsets count code points; ends are exclusive. n_email, n_ip, n_card and n_phone count base spans;
  added spans have kinds of their own, listed behind the base kinds.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_or_empty

# The base patterns. A run of characters that a match may start with is only entered
# at its front or where the last match ended, and repetitions that nothing follows are possessive;
# neither changes a match, and both keep long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Kinds in the order they are listed.
KINDS = ("email", "ip", "card", "phone", "email_alt", "ip_alt", "card_alt", "phone_alt", "secret")

_AT = r"(?:\x20?[(\[{]\x20?(?:at|AT)\x20?[)\]}]\x20?|\x20(?:at|AT)\x20)"
_DOT = r"(?:\x20?[(\[{]\x20?(?:dot|DOT)\x20?[)\]}]\x20?|\x20(?:dot|DOT)\x20|\.)"
_HEX = r"[0-9A-Fa-f]{1,4}"
_HEXES = r"(?:" + _HEX + r"(?::" + _HEX + r"){0,6})"
#: Generators: kind and pattern.
GENERATORS = {
    "email_alt": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+" + _AT + r"[A-Za-z0-9-]++(?:" + _DOT + r"[A-Za-z0-9-]++)+",
    # Whole addresses of two colons or more, or one "::" at any place; no run has more than eight colons.
    "ip_alt": r"(?<![0-9A-Fa-f])(?<![0-9A-Fa-f:]:)(?!(?:[0-9A-Fa-f]*+:){9})(?:(?:" + _HEX + r":){2,7}" + _HEX + r"|" + _HEXES + r"?::" + _HEXES + r"?)(?![0-9A-Fa-f]|::|:[0-9A-Fa-f])",
    "card_alt": r"(?<![0-9])[0-9](?:[\x20./_-]?[0-9]){12,18}(?![0-9])",
    "phone_alt": r"(?<![0-9])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9])",
    # Runs as long as a key or access token, with a digit early on.
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]{0,63}[0-9])[A-Za-z0-9_/+-]{20,200}+={0,2}+(?![A-Za-z0-9_/+=-])",
}


#: What a generator's or base pattern's match is: its place, itself, and what stands around it.
_SPAN = "struct<start:int,end:int,match:string,left:string,before:string,after:string>"
#: Characters kept of what stands before a match.
_LEFT = 24


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, join) -> Column:
    """Running sums (or maxima, ...) of a non-empty array, in as many rounds as its size has binary digits.

    In each round an element is joined with the one twice as far before it as in the last round.
    """
    rounds = F.sequence(F.lit(0), F.floor(F.log2(F.size(values))).cast("int"))
    step = lambda k: F.call_function("shiftleft", F.lit(1), k)
    return F.aggregate(rounds, values, lambda s, k: F.transform(s, lambda x, i: F.when(i >= step(k), join(x, F.get(s, i - step(k)))).otherwise(x)))


def found(text: Column, pattern: str) -> Column:
    """All matches, leftmost and non-overlapping, as an array of _SPAN.

    There is no function for the places of all matches; they follow from the lengths of the matches
    and of the pieces between them. ``left``: the end of the piece before the match.
    """

    def spans(b: Column) -> Column:
        n = F.size(b["m"])
        sizes = F.zip_with(F.slice(b["g"], F.lit(1), n), b["m"], lambda g, m: F.length(g) + F.length(m))

        def span(ends: Column, m: Column, i: Column) -> Column:
            gap, after = F.get(b["g"], i), F.get(b["g"], i + 1)
            before = F.when(gap != "", F.substring(gap, -1, 1)).when(i > 0, F.substring(F.get(b["m"], i - 1), -1, 1)).otherwise("")
            behind = F.when(after != "", F.substring(after, 1, 1)).otherwise(F.coalesce(F.substring(F.get(b["m"], i + 1), 1, 1), F.lit("")))
            end = F.get(ends, i)
            return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match"), F.substring(gap, -_LEFT, _LEFT).alias("left"), before.alias("before"), behind.alias("after"))

        places = _let(_running(sizes, lambda x, y: x + y), lambda ends: F.transform(b["m"], lambda m, i: span(ends, m, i)))
        return F.when(n > 0, places).otherwise(_none())

    return _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")), spans)


def _none() -> Column:
    return F.expr(f"CAST(array() AS array<{_SPAN}>)")


def _clear_of(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base``, in one sweep over both.

    In order of a span's end and a base span's start, the furthest end of the base spans so far lies
    beyond the span's start if and only if one of them overlaps it.
    """
    of_base = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("tag"), b["end"].alias("reach"), F.lit(None).cast(_SPAN).alias("span")))
    of_spans = F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("tag"), F.lit(0).alias("reach"), s.alias("span")))

    def sweep(events: Column) -> Column:
        reach = _running(F.transform(events, lambda e: e["reach"]), F.greatest)
        free = _let(reach, lambda r: F.filter(events, lambda e, i: (e["tag"] == 0) & (F.get(r, i) <= e["span"]["start"])))
        return F.transform(free, lambda e: e["span"])

    return F.when((F.size(base) == 0) | (F.size(spans) == 0), spans).otherwise(_let(F.array_sort(F.concat(of_spans, of_base)), sweep))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substr(back, i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))), F.lit(0), add) % 10 == 0


def _between(n: Column, least: int, most: int) -> Column:
    return (n >= least) & (n <= most)


def base_spans(text: Column) -> dict[str, Column]:
    """By base kind, the array of spans (start, end, match)."""
    number = text.rlike("[0-9]")
    where = lambda cond, pattern: F.when(cond, found(text, pattern)).otherwise(_none())
    small = lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False))
    return {
        "email": where(F.contains(text, F.lit("@")), EMAIL),
        "ip": F.filter(where(number & F.contains(text, F.lit(".")), IP), lambda s: F.forall(F.split(s["match"], r"\."), small)),
        "card": F.filter(where(number, CARD), lambda s: _between(F.length(digits_of(s["match"])), 14, 19) & luhn(digits_of(s["match"]))),
        "phone": F.filter(where(number & F.contains(text, F.lit("+")), PHONE), lambda s: _between(F.length(digits_of(s["match"])), 10, 15)),
    }


#: Words before a span that hint at its kind, one pattern a feature.
CUES = {"phone": r"(?:tel|phone|fax|call|mobile|cell)[^a-z]*$", "card": r"(?:card|visa|credit|iban|account)[^a-z]*$", "host": r"(?:ip|host|ipv6|address|server)[^a-z]*$", "mail": r"(?:mail|contact|write to)[^a-z]*$", "secret": r"(?:token|key|secret|password|passwd|bearer|auth)[^a-z]*$", "digest": r"(?:commit|sha|hash|digest|md5|uuid|etag)[^a-z]*$", "other": r"(?:order|no|id|isbn|version|date|invoice|ref|total|page)[^a-z]*$"}
FEATURES = ("generator", "digits", "letters", "signs", "groups", "longest", "shortest", "turns", "luhn", "bracket", "spelled", "domain", "before", "after", *CUES)


def _char_class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[A-Za-z]"), 2).when(c.rlike("^[0-9]"), 3).when(c.rlike("^[$%#+=/-]"), 4).otherwise(5)


def features(span: Column, generator: int) -> Column:
    """A struct of small integers: format of the span, context around it."""
    m = span["match"]
    digits = digits_of(m)
    groups = F.transform(F.filter(F.split(m, "[^A-Za-z0-9]+"), lambda g: g != ""), F.length)
    left = F.lower(span["left"])
    value = {
        "generator": F.lit(generator), "digits": F.length(digits), "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")), "signs": F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")),
        "groups": F.size(groups), "longest": F.array_max(groups), "shortest": F.array_min(groups), "turns": F.regexp_count(m, F.lit("[A-Za-z][0-9]")), "luhn": (_between(F.length(digits), 13, 19) & luhn(digits)).cast("int"),
        "bracket": m.rlike(r"[(\[{]").cast("int"), "spelled": m.rlike("(?i)[^a-z]dot[^a-z]").cast("int"), "domain": m.rlike("(?i)[^a-z](?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$").cast("int"),
        "before": _char_class(span["before"]), "after": _char_class(span["after"]),
    } | {name: left.rlike(cue).cast("int") for name, cue in CUES.items()}
    return F.struct(*[F.coalesce(value[name].cast("int"), F.lit(0)).alias(name) for name in FEATURES])


# Templates: generator, text before, span, text after, whether it is personal data (None: if it
# passes the Luhn test). '#' stands for a digit, '~' for a hexadecimal digit, '@' for a letter.
TEMPLATES = (
    ("phone_alt", "call ", "(###) ###-####", " now", 1), ("phone_alt", "tel: ", "###-###-####", ".", 1), ("phone_alt", "phone ", "### ### ####", "", 1),
    ("phone_alt", "and ", "(###) ###-####", " or", 1), ("phone_alt", "fax ", "###.###.####", "", 1), ("phone_alt", "mobile ", "0### ### ## ##", "", 1),
    ("phone_alt", "of ", "###-###-####", " the", 1), ("phone_alt", "cell ", "##########", "", 1),
    ("phone_alt", "on ", "####-##-##", " at", 0), ("phone_alt", "date ", "##.##.####", "", 0), ("phone_alt", "order ", "########", "", 0),
    ("phone_alt", "id ", "##########", "", 0), ("phone_alt", "version ", "##.##.####", "", 0), ("phone_alt", "from ", "####-####", "", 0),
    ("phone_alt", "$", "#######", "", 0), ("phone_alt", "ref ", "###-###-####", "", 0), ("phone_alt", "the ", "##########", " of", 0),
    ("phone_alt", "isbn ", "###-#-##-######-#", "", 0), ("phone_alt", "total ", "### ### ###", "", 0), ("phone_alt", "in ", "#### #### ###", "", 0),
    ("phone_alt", "+# ", "(###) ###-####", "", 0), ("phone_alt", "x", "#######", "y", 0), ("phone_alt", "and ", "###########", " a", 0),
    ("ip_alt", "host ", "~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~", "", 1), ("ip_alt", "ip ", "~~~~:~~~::~~~~", "", 1), ("ip_alt", "from ", "~~~~:~~~~:~~~~:~~~~::~~~~", " to", 1),
    ("ip_alt", "at ", "##:##:##", "", 0), ("ip_alt", "time ", "#:##:##", "", 0), ("ip_alt", "id ", "~~:~~:~~:~~:~~:~~", "", 0), ("ip_alt", "ratio ", "#:#:#", "", 0),
    ("ip_alt", "ip:", "~~~~:~~~::~", ".", 1), ("ip_alt", "ip ", "~~~~::~", "", 1), ("ip_alt", "host ", "~~~~:~~~::~~~~:~~~:~~~~", "", 1), ("ip_alt", "from ", "~~~~::~~~:~~~~:~~~~:~~~~", " to", 1), ("ip_alt", "server ", "::~~~~:~~~~", "", 1),
    ("ip_alt", "address ", "::~", "", 1), ("ip_alt", "on ", "~~~~:~~~~:~~~~::", " and", 1), ("ip_alt", "and ", "~~~~::~~~~", " or", 1), ("ip_alt", "the ", "~~~~:~~~::~~~~", ".", 1),
    ("ip_alt", "std", "::", "@@@@@", 0), ("ip_alt", "type ", "::", " is", 0), ("ip_alt", "list[", "::#", "]", 0), ("ip_alt", "of ", "##:##:##", " the", 0), ("ip_alt", "and ", "~~:~~:~~:~~:~~:~~", " or", 0),
    ("phone_alt", "mobile: ", "0# ## ## ## ##", "", 1), ("phone_alt", "tel ", "## ## ## ## ##", ",", 1), ("phone_alt", "call ", "###.###.####", "", 1), ("phone_alt", "phone: ", "(0##) #### ###", "", 1),
    ("phone_alt", "fax: ", "### ### ####", ".", 1), ("phone_alt", "or ", "(###) ### ####", ",", 1), ("phone_alt", "page ", "###-####", "", 0), ("phone_alt", "date: ", "####/##/##", "", 0),
    ("phone_alt", "invoice ", "######-####", "", 0), ("phone_alt", "was ", "#######", " in", 0), ("phone_alt", "of ", "## ### ###", " to", 0), ("phone_alt", "total: ", "#.###.###", "", 0),
    ("email_alt", "mail ", "@@@@@ (at) @@@@@@ (dot) com", "", 1), ("email_alt", "contact ", "@@@@.@@@@ [at] @@@@@@@.org", "", 1), ("email_alt", "or ", "@@@@@@ at @@@@@ dot net", " x", 1),
    ("email_alt", "write to ", "@@@@ [at] @@@@@@ [dot] de", ".", 1), ("email_alt", "e-mail: ", "@@@@@## {at} @@@@ {dot} fr", "", 1), ("email_alt", "and ", "@@@@@ (AT) @@@@@@@ (DOT) com", ",", 1),
    ("email_alt", "contact: ", "@@@ at @@@@@ dot @@@@ dot edu", "", 1), ("email_alt", "mail me, ", "@@@@@ at @@@@@@@.com", "", 1), ("email_alt", "mail: ", "@@@@_@@@ at @@@@@.net", " or", 1),
    ("email_alt", "he is ", "@@@@@ at @@@@.@@@@@", " and", 0), ("email_alt", "look ", "@@@ at @@@.@@@@", "", 0), ("email_alt", "meet ", "@@@@ at @@@@@.@@", "", 0),
    ("email_alt", "was ", "@@@@ at ####.##", " to", 0), ("email_alt", "they ", "@@@@@@ at @@@.@@@", " for", 0), ("email_alt", "open ", "@@@@@@@ at ##.##", "", 0), ("email_alt", "it ", "@@ at @@@@@@.@@@@@@@", "", 0),
    ("card_alt", "card ", "####.####.####.####", "", None), ("card_alt", "visa ", "####/####/####/####", "", None), ("card_alt", "credit ", "####_####_####_####", "", None), ("card_alt", "card: ", "####.######.#####", ".", None),
    ("card_alt", "pay with ", "####.####.####.####", " now", None), ("card_alt", "by ", "####/####/####/####", ",", None), ("card_alt", "and ", "####_####_####_####", "", None), ("card_alt", "credit card ", "####/######/#####", ",", None),
    ("card_alt", "account ", "#############", "", 0), ("card_alt", "iban ", "##############", "", 0), ("card_alt", "order ", "####-####-####-####", "", 0), ("card_alt", "ref ", "####.####.####.####", "", 0),
    ("card_alt", "the ", "##############", " a", 0), ("card_alt", "in ", "#############", ",", 0), ("card_alt", "isbn ", "###.#.##.######.#", "", 0), ("card_alt", "no ", "##.##.####.##.##.####", "", 0),
    ("card_alt", "page ", "#############", "", 0), ("card_alt", "id ", "################", "", 0), ("card_alt", "total ", "###.###.###.###.###", "", 0), ("card_alt", "of ", "###.###.###.###.###", " to", 0),
    ("card_alt", "in ", "###.###.###.###.###", ",", 0), ("card_alt", "was ", "##.###.###.###.###", "", 0), ("card_alt", "and ", "###.###.###.###.###.###", "", 0), ("card_alt", "as ", "#.###.###.###.###", " of", 0),
    ("secret", 'token = "', "~" * 40, '"', 1), ("secret", "api_key: ", "~" * 32, "", 1), ("secret", "secret=", "@#@@#@@@#@@#@#@@#@#@@@#@", "", 1), ("secret", "password: ", "@@#@@_#@@@#@-#@@@@#@#@@", ",", 1),
    ("secret", "bearer ", "@@@#@@#@@@@#@#@@@@#@@@#@@#@@@@@#@#@@", "", 1), ("secret", 'and "', "~" * 40, '"', 1), ("secret", "with key ", "sk-@#@@@#@@#@@@@@#@#@@@#@", ".", 1), ("secret", 'Token = "', "~" * 40, '"!!', 1),
    ("secret", "of ", "~" * 32, " to", 1), ("secret", "token ", "gh@_@@#@@@#@@#@@@@@#@#@@@#@@#", "", 1), ("secret", "auth ", "~" * 48, "", 1), ("secret", 'or "', "~" * 32, '",', 1),
    ("secret", "commit ", "~" * 40, " by", 0), ("secret", "sha256 ", "~" * 64, "", 0), ("secret", "md5: ", "~" * 32, "", 0), ("secret", "see ", "@@@@@@-@@@@@@@-@@@@@-####", " for", 0),
    ("secret", "uuid ", "~~~~~~~~-~~~~-~~~~-~~~~-~~~~~~~~~~~~", "", 0), ("secret", "file ", "@@@@@_@@@@@@@_@@@@_##", "", 0), ("secret", "hash ", "~" * 40, "", 0), ("secret", "on ", "@@@@@-##-##-####-@@@@@@", "", 0),
    ("secret", "the ", "@" * 23 + "#", " of", 0), ("secret", "digest=", "~" * 64, "", 0), ("secret", "id ", "#" * 22, "", 0), ("secret", "in ", "@@@@-@@@@@-@@@@@@@-@@@@-#", ".", 0),
    ("secret", "and ", "#" * 24, " or", 0), ("secret", "at ", "@@@@@/@@@@@@/@@@@@@@@/##", ",", 0), ("secret", "to ", "@" * 21 + "##", "", 0), ("secret", "commit: ", "~" * 40, ".", 0),
)
#: Rows written from each template, and parts that the templates are dealt into for calibration.
WRITTEN, FOLDS = 128, 5


def _written(spark: SparkSession, rows: int = WRITTEN) -> DataFrame:
    """(kind, text, y, fold): template rows with their signs filled in by hash."""
    t = spark.createDataFrame([(i, g, a, s, b, -1 if y is None else y) for i, (g, a, s, b, y) in enumerate(TEMPLATES)], "i int, kind string, a string, s string, b string, y int")
    t = t.crossJoin(spark.range(rows).withColumnRenamed("id", "n"))  # fixed sizes on both sides
    drawn = lambda k: F.pmod(F.xxhash64("i", "n", k), F.lit(1 << 20)).cast("int")
    filled = F.transform(F.split(F.concat("a", "s", "b"), ""), lambda c, k: (
        F.when(c == "#", F.substr(F.lit("0123456789"), drawn(k) % 10 + 1, F.lit(1))).when(c == "~", F.substr(F.lit("0123456789abcdef"), drawn(k) % 16 + 1, F.lit(1)))
        .when(c == "@", F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), drawn(k) % 26 + 1, F.lit(1))).otherwise(c)
    ))
    # Templates of one kind and label go to the folds in turn; no template is in two.
    turn = dict[tuple, int]()
    folds = []
    for g, *_, y in TEMPLATES:
        turn[g, y] = turn.get((g, y), -1) + 1
        folds.append(turn[g, y] % FOLDS)
    return t.select("kind", F.concat_ws("", filled).alias("text"), "y", F.element_at(F.array(*map(F.lit, folds)), F.col("i") + 1).alias("fold"))


def _boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 1.0) -> list:
    """Second-order boosting of the logistic loss on integer features; a tree is nested tuples."""
    values = [np.unique(x[:, f]) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(v, x[:, f]) for f, v in enumerate(values)])
    margin, trees = np.zeros(len(y)), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        for f in range(len(values)) if left else ():
            # Sums over the rows up to each value but the last.
            low_g, low_h = (np.cumsum(np.bincount(code[f, rows], s[rows], len(values[f])))[:-1] for s in (g, h))
            high_g, high_h = total_g - low_g, total_h - low_h
            gain = np.where((low_h > 1) & (high_h > 1), low_g**2 / (low_h + penalty) + high_g**2 / (high_h + penalty) - total_g**2 / (total_h + penalty), 0.0)
            if len(gain) and gain.max() > best[0] + 1e-12:
                best = (float(gain.max()), f, int(values[f][gain.argmax()]))
        if best[1] is None:
            return float(-rate * total_g / (total_h + penalty))
        low = x[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), w * (p - y), w * p * (1 - p), depth)
        trees.append(tree)
        margin += _leaves(tree, x)
    return trees


def _leaves(tree, x: np.ndarray) -> np.ndarray:
    """A tree's value for each row."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _leaves(tree[2], x), _leaves(tree[3], x))


def _tree_sql(tree, at: str, generator: int) -> str:
    """A tree's value over the struct ``at``; splits on the generator, which is known, need no condition."""
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    low, high = (_tree_sql(t, at, generator) for t in tree[2:])
    if FEATURES[tree[0]] == "generator":
        return low if generator <= tree[1] else high
    return f"IF({at}.{FEATURES[tree[0]]} <= {tree[1]}, {low}, {high})"


class SpanModel:
    """``recall``: by kind, the share of true spans of templates that the trees did not see that reaches the threshold."""

    def __init__(self, trees: list, thresholds: dict[str, float], recall: dict[str, float]):
        self.trees, self.thresholds, self.recall = trees, thresholds, recall

    def score(self, at: str, generator: int) -> str:
        """SQL of the score of a struct of features; as text, since thousands of columns are slow to make one by one."""
        return " + ".join(_tree_sql(tree, at, generator) for tree in self.trees)


def _candidates(text: Column, kind: str) -> Column:
    """The generator's spans; texts that cannot hold one are passed over by tests that each of its matches meets."""
    likely = {
        "email_alt": lambda: text.rlike(_AT + r"[A-Za-z0-9-]++" + _DOT + r"[A-Za-z0-9-]"),
        "ip_alt": lambda: F.contains(text, F.lit("::")) | (F.contains(text, F.lit(":")) & text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]")),
        "card_alt": lambda: text.rlike(r"[0-9](?:[\x20./_-]?[0-9]){12}"),
        "phone_alt": lambda: text.rlike(r"[0-9](?:[\x20().-]{0,2}[0-9]){6}"),
        "secret": lambda: text.rlike("[0-9]") & text.rlike(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20}"),
    }
    return F.when(likely[kind](), found(text, GENERATORS[kind])).otherwise(_none())


def fit(spark: SparkSession, rows: int = WRITTEN, right: float = 0.98) -> SpanModel:
    """Trees on all template rows; thresholds by trees that did not see the template they score.

    For each kind the threshold is the lowest score from which on the held templates' spans are right
    to the share ``right``. At most len(TEMPLATES) * rows feature rows come to the driver, whatever
    the corpus holds.
    """
    written = _written(spark, rows)
    spans = None
    for k, kind in enumerate(GENERATORS):
        one = written.where(F.col("kind") == kind)
        one = one.select(F.explode(_candidates(F.col("text"), kind)).alias("span"), "y", "fold").select(features(F.col("span"), k).alias("f"), "y", "fold")
        spans = one if spans is None else spans.unionByName(one)
    y = F.when(F.col("y") < 0, F.col("f.luhn")).otherwise(F.col("y"))
    cells = spans.groupBy("f", "fold").agg(F.sum(y).alias("yes"), F.count("*").alias("n")).collect()
    cells = sorted((tuple(c["f"]), c["fold"], c["yes"], c["n"]) for c in cells)
    x = np.array([c[0] for c in cells for _ in (0, 1)], dtype=np.int64)
    fold = np.array([c[1] for c in cells for _ in (0, 1)])
    label = np.array([v for _ in cells for v in (1.0, 0.0)])
    weight = np.array([v for c in cells for v in (c[2], c[3] - c[2])], dtype=float)
    x, fold, label, weight = (v[weight > 0] for v in (x, fold, label, weight))

    z = np.zeros(len(x))
    for k in range(FOLDS):
        seen, held = fold != k, fold == k
        trees = _boost(x[seen], label[seen], weight[seen])
        z[held] = sum(_leaves(t, x[held]) for t in trees)
    thresholds, recall = {}, {}
    for k, kind in enumerate(GENERATORS):
        thresholds[kind] = math.inf
        own = x[:, 0] == k
        for cut in sorted(set(z[own].tolist()), reverse=True):
            of = own & (z >= cut)
            if cut >= 0 and (weight[of] * label[of]).sum() >= right * weight[of].sum():
                thresholds[kind] = cut - 1e-9
        true = weight * label * own
        recall[kind] = float(true[z >= thresholds[kind]].sum() / max(true.sum(), 1e-9))
    return SpanModel(_boost(x, label, weight), thresholds, recall)


def _placed(spans: Column, place: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("kind"), s["end"].alias("end")))


def _measured(text: Column, kind: str, generator: int) -> Column:
    """(start, kind, end, f) of the generator's candidates that overlap no base span."""
    place = F.lit(KINDS.index(kind)).alias("kind")
    return F.transform(_clear_of(_candidates(text, kind), F.col("base")), lambda s: F.struct(s["start"].alias("start"), place, s["end"].alias("end"), features(s, generator).alias("f")))


def _selected(measured: str, kind: str, generator: int, model: SpanModel) -> Column:
    """(start, kind, end) of those that reach their threshold."""
    right = f"filter({measured}, m -> {model.score('m.f', generator)} >= {model.thresholds[kind]!r}D)"
    return F.transform(F.expr(right), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))


def _count(spans: Column, place: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == place)).cast("long")


def find(docs: DataFrame, model: SpanModel | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: doc_id, base and added, arrays of (start, kind, end), kind by its place in KINDS.

    ``carry``: further columns of ``docs`` to give, under names with ``__of_`` in front.
    """
    model = model or fit(docs.sparkSession)
    text = F.col("text")
    carried = [F.col(c).alias(f"__of_{c}") for c in carry]
    base = base_spans(text)
    with_base = docs.select("doc_id", text_or_empty().alias("text"), *carried).withColumn("base", F.concat(*[_placed(base[kind], k) for k, kind in enumerate(KINDS[:4])]))
    used = [(k, kind) for k, kind in enumerate(GENERATORS) if model.thresholds[kind] < math.inf]
    with_base = with_base.withColumns({f"__{kind}": _measured(text, kind, k) for k, kind in used})
    proposed = [_selected(f"__{kind}", kind, k, model) for k, kind in used]
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")
    return with_base.select("doc_id", "base", F.concat(none, *proposed).alias("added"), *[f"__of_{c}" for c in carry])


def written(spans: Column) -> Column:
    """Spans as kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))


def redacted(docs: DataFrame, mask: str = "*", model: SpanModel | None = None) -> DataFrame:
    """doc_id and text, in which every span is masked, code point by code point; overlapping spans are masked together."""
    found_ = find(docs, model, ("text",)).select("doc_id", F.coalesce("__of_text", F.lit("")).alias("text"), F.array_sort(F.concat("base", "added")).alias("spans"))

    def masked(spans: Column) -> Column:
        reach = _running(F.transform(spans, lambda s: s["end"]), F.greatest)

        def pieces(b: Column) -> Column:
            # What is clear before each span, and the span from where the spans before it end.
            upto = lambda i: F.when(i > 0, F.get(b["reach"], i - 1)).otherwise(0)
            clear = lambda s, i: F.array_join(F.slice(b["points"], upto(i) + 1, F.greatest(s["start"] - upto(i), F.lit(0))), "")
            hidden = lambda s, i: F.repeat(F.lit(mask), F.greatest(s["end"] - F.greatest(s["start"], upto(i)), F.lit(0)))
            parts = F.transform(spans, lambda s, i: F.concat(clear(s, i), hidden(s, i)))
            last = F.element_at(b["reach"], -1)
            return F.concat(F.array_join(parts, ""), F.array_join(F.slice(b["points"], last + 1, F.greatest(F.size(b["points"]) - last, F.lit(0))), ""))

        return _let(F.struct(reach.alias("reach"), F.split("text", "").alias("points")), pieces)

    return found_.select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(_let(F.col("spans"), masked)).alias("text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find(read(spark, sf_dir, "documents"))
    counts = [_count(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return spans.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"), F.size(F.concat("base", "added")).cast("long").alias("n_spans"))
