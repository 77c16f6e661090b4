"""Personal data: candidate generation and gradient boosting, in SQL functions alone.

Four base kinds (email, ip, card, phone) are found by fixed patterns and checks and always stay.
High-recall generators propose further spans, which may overlap: secrets, values assigned to a
credential's name, social security numbers, bank account numbers, phone numbers without a country
code, masked e-mail addresses. A proposal becomes an array of format and context features, once.
Each generator has its own boosted trees, all splits of a level alike, so that a tree is a few
numbers in an array that one ``aggregate`` walks; a threshold for each kind, calibrated on held-out
examples, selects, and among overlapping spans the best scored stays. Spans that meet a base span
add nothing.

The trees are fitted on the driver from generated examples (a fixed number, labelled by the rule
that made them), whose features come from the same SQL expressions. Texts stay in the JVM: there
are no Python functions, pandas, Arrow or RDDs.

Positions: one pass of each pattern puts a mark around its matches, and sums of the code points
between marks are the starts and ends. Patterns are possessive, so that long runs take linear time;
sums and overlaps are made in bounded steps, so that a text with very many spans does too.

Defined cases: null and empty text has no spans; repeated rows each get their row; an empty table
gives an empty result; extra columns are ignored (``redact`` keeps them, whatever their names).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread

KINDS = ("email", "ip", "card", "phone")
#: The mark around matches, and what stands for it where a text holds it: no pattern names either.
MARK, STAND_IN = "\uffff", "\ufffe"

# The base patterns, as given, with loops made possessive and starts tied to the
# start of a run or to the end of the match before.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Generators: kind, what comes before the span, the span, and what a text must hold to be tried.
GENERATORS = (
    ("secret", "", r"(?<![A-Za-z0-9_+/=-])(?:(?=[A-Za-z_+/=-]*+[0-9])|(?=A[KS]IA))[A-Za-z0-9_+/=-]{20,}+", r"[A-Za-z0-9_+/=-]{20}"),
    ("credential", r"(?i:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\x20{0,2}[=:]\x20{0,2}[\"']?|(?i:bearer)\x20", r"[^\s\"'=:]{6,}+", r"[nNtTdDyY][\"']?\x20{0,2}[=:]\x20{0,2}[\"']?[^\s\"'=:]{6}|[aA][rR][eE][rR]\x20"),
    ("ssn", "", r"(?<![0-9-])[0-9]{3}([-\x20])[0-9]{2}\3[0-9]{4}(?![0-9-])", r"[0-9][-\x20][0-9]{2}[-\x20][0-9]"),
    ("iban", "", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    ("local_phone", "", r"(?<![0-9+.-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    ("masked_email", "", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:\x20?(?i:\(at\)|\[at\]|\{at\})\x20?|\x20(?i:at)\x20)[A-Za-z0-9-]++(?:(?:\x20?(?i:\.|\(dot\)|\[dot\]|\{dot\})\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]++)++", r"[(\[{][aA][tT][)\]}]|\x20[dD][oO][tT]\x20"),
)
NAMES = (*KINDS, *(g[0] for g in GENERATORS))
CUES = ("secret|token|key|passw|pwd|auth|bearer|credential", "ssn|social|tax", "iban|account|bank|konto", "phone|tel|call|fax|mobile|cell|text me|reach", "mail|contact|write|reach")
AGAINST = "order|invoice|isbn|issn|version|build|commit|serial|sku|part|sha|md5|checksum|hash|digest|revision|etag|item|model|ticket|case no|doi|uuid|guid"
PREFIX = "^(?:A[KS]IA|gh[opsu]_|github_pat_|glpat-|[sp]k[-_]|xox[abp]-|AIza|eyJ|npm_|SG\\.)"
EMPTY_VALUE = r"^[<$%{(\[*@]|\(|^[xX*.-]+$|environ|\.env|example|your|change|^(?:null|none|true|false|undefined|string)\b"
FEATURES = ("length", "digits", "capitals", "smalls", "separators", "variety", "hex", "known_prefix", "valid", "turns", "cases", "word", "vowels", "stand_in", "bracketed", "cue_secret", "cue_ssn", "cue_bank", "cue_phone", "cue_mail", "against", "quoted", "joined")
#: Generated examples, trees for each generator, splits of a tree, shrinkage, cuts tried for a
#: feature, and the held-out precision of a threshold.
EXAMPLES, TREES, DEPTH, RATE, CUTS, PRECISION = 9_000, 24, 4, 0.3, 24, 0.98
#: Values that are summed at a time, characters before a span that are looked at, and characters of
#: a text that are cut out of at a time.
STEP, AROUND, BLOCK = 256, 32, 4096

FOUND = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
SCORED = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"
PLACED = "array<struct<start:int,rank:int,end:int,kind:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` over each prefix of an array of ints, ``STEP`` values at a time."""
    none = F.array().cast("array<int>")

    def fold(part: Column) -> Column:
        return F.aggregate(part, none, lambda acc, x: F.array_append(acc, F.when(F.size(acc) > 0, op(F.get(acc, F.size(acc) - 1), x)).otherwise(x)))

    def joined(parts: Column) -> Column:
        tops = fold(F.transform(parts, lambda p: F.get(p, F.size(p) - 1)))
        return let(tops, lambda t: F.flatten(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.transform(p, lambda x: op(x, F.get(t, k - 1)))))))

    def steps(v: Column) -> Column:
        at = lambda k: F.sequence(k * STEP, F.least((k + 1) * STEP, F.size(v)) - 1)
        parts = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / STEP).cast("int")), lambda k: fold(F.transform(at(k), lambda i: F.get(v, i))))
        return F.when(F.size(v) > 0, let(parts, joined)).otherwise(none)

    return let(values, steps)


def marked(text: Column, before: str, pattern: str) -> Column:
    """The text with a mark around each leftmost, non-overlapping match that follows ``before``."""
    return F.regexp_replace(text, F.lit(f"({before})({pattern})"), F.lit(f"$1{MARK}$2{MARK}"))


def located(text: Column) -> Column:
    """The marked matches with their code point positions and the text around them."""

    def spans(parts: Column) -> Column:
        odd = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
        ends = running(F.transform(parts, F.char_length), lambda a, b: a + b)
        near = lambda k: F.concat(*(F.coalesce(F.get(parts, F.when(k >= i, k - i)), F.lit("")) for i in (3, 2, 1)))
        row = lambda e, k: F.struct(F.get(e, k - 1).alias("start"), F.get(e, k).alias("end"), F.get(parts, k).alias("match"), F.right(near(k), F.lit(AROUND)).alias("before"), F.substring(F.get(parts, k + 1), 1, 1).alias("after"))
        return let(ends, lambda e: F.transform(odd, lambda k: row(e, k)))

    return let(F.split(text, MARK), lambda parts: F.when(F.size(parts) > 2, spans(parts)).otherwise(F.array().cast(FOUND)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _octets_fit(x: Column) -> Column:
    parts = F.transform(F.split(x, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))


def _passes(rank: Column, match: Column) -> Column:
    """Whether a base match of the kind ``rank`` passes its check."""
    by_digits = let(_digits(match), lambda d: F.when(rank == 3, F.length(d).between(10, 15)).otherwise(F.length(d).between(14, 19) & F.call_function("luhn_check", d)))
    return F.when(rank == 0, True).when(rank == 1, _octets_fit(match)).otherwise(by_digits)


def remainder(iban: Column) -> Column:
    """The remainder by 97 of an account number, letters read as 10 to 35."""
    plain = F.regexp_replace(iban, r"\x20", "")
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")
    return F.aggregate(turned, F.lit(0), lambda acc, c: F.when(c.between("0", "9"), F.pmod(acc * 10 + F.ascii(c) - 48, F.lit(97))).when(c.between("A", "Z"), F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97))).otherwise(acc))


def features(generator: Column, match: Column, before: Column, after: Column) -> Column:
    """A proposal's format and context as numbers; ``before`` holds up to 32 characters, ``after``
    one."""
    kind = {g[0]: k for k, g in enumerate(GENERATORS)}
    flag = lambda c: F.when(c, 1).otherwise(0)
    without = lambda pattern: F.length(match) - F.length(F.regexp_replace(match, pattern, ""))
    borders = lambda a, b: F.size(F.split(match, f"(?<=[{a}])(?=[{b}])|(?<=[{b}])(?=[{a}])")) - 1
    area = F.substring(_digits(match), 1, 3)
    ssn = ~area.rlike("^(?:000|666|9)") & ~match.rlike("[- ]00[- ]|0000$")
    phone = _digits(match).rlike("^[2-9][0-9]{2}[2-9]")
    valid = F.when(generator == kind["iban"], flag(remainder(match) == 1)).when(generator == kind["ssn"], flag(ssn)).when(generator == kind["local_phone"], flag(phone)).otherwise(0)

    def made(near: Column) -> list[Column]:
        return [
            F.length(match),
            without("[0-9]"),
            without("[A-Z]"),
            without("[a-z]"),
            without("[^A-Za-z0-9]"),
            F.size(F.array_distinct(F.split(match, ""))),
            flag(match.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
            flag(match.rlike(PREFIX)),
            valid,
            borders("A-Za-z", "0-9"),
            borders("a-z", "A-Z"),
            F.coalesce(F.array_max(F.transform(F.split(match, "[^a-z]+"), F.length)), F.lit(0)),
            without("(?i)[aeiou]"),
            flag(match.rlike(EMPTY_VALUE)),
            flag(match.rlike(r"(?i)[(\[{]at[)\]}]\s?[A-Za-z]|\x20dot\x20")),
            *(flag(near.rlike(cue)) for cue in CUES),
            flag(near.rlike(f"(?:{AGAINST})")),
            flag(before.rlike("[\"'=:]\\x20?$")),
            flag(before.rlike("[A-Za-z0-9/_.-]$") | after.rlike("^[A-Za-z0-9/_]")),
        ]

    return let(F.lower(before), lambda near: F.array(*(c.cast("double") for c in made(near))))


@dataclass
class Tree:
    """Splits (feature, cut), one for each level, and the values of the leaves: bit k of a leaf's
    number says whether the feature of level k is above its cut."""

    splits: list[tuple[int, float]]
    values: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.values)[sum((x[:, f] > cut).astype(int) << k for k, (f, cut) in enumerate(self.splits))]

    def sql(self) -> str:
        listed = lambda xs, end: ", ".join(f"{x}{end}" for x in xs)
        return f"named_struct('f', array({listed([f for f, _ in self.splits], '')}), 'c', array({listed([f'{c:.4f}' for _, c in self.splits], 'D')}), 'v', array({listed([f'{v:.6f}' for v in self.values], 'D')}))"


def _grow(bins: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> Tree:
    leaf, splits = np.zeros(len(bins), int), []
    for level in range(DEPTH):
        best, choice = -1.0, (0, 0)
        for f, own in enumerate(cuts):
            if not len(own):
                continue
            n = len(own) + 1
            at, shape = leaf * n + bins[:, f], (1 << level, n)
            g = np.bincount(at, gradient, shape[0] * n).reshape(shape).cumsum(1)
            h = np.bincount(at, hessian, shape[0] * n).reshape(shape).cumsum(1)
            gain = (g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1)).sum(0)[:-1]
            if gain.max() > best + 1e-9:
                best, choice = gain.max(), (f, int(gain.argmax()))
        f, k = choice
        splits.append((f, round(float(cuts[f][k]), 4)))
        leaf = leaf + ((bins[:, f] > k).astype(int) << level)
    g, h = (np.bincount(leaf, x, 1 << DEPTH) for x in (gradient, hessian))
    return Tree(splits, [round(float(v), 6) for v in -RATE * g / (h + 1)])


@dataclass
class Model:
    """Trees and threshold of each generator."""

    trees: list[list[Tree]]
    thresholds: list[float]

    def score(self, generator: Column, x: Column) -> Column:
        forests = F.expr("array(" + ", ".join(f"array({', '.join(t.sql() for t in trees)})" for trees in self.trees) + ")")

        def add(acc: Column, t: Column) -> Column:
            bits = [F.when(F.get(x, F.get(t["f"], F.lit(k))) > F.get(t["c"], F.lit(k)), 1 << k).otherwise(0) for k in range(DEPTH)]
            return acc + F.get(t["v"], sum(bits[1:], bits[0]))

        return F.aggregate(F.get(forests, generator), F.lit(0.0), add)

    def scored(self, generator: Column, x: Column) -> Column:
        return let(x, lambda own: self.score(generator, own))

    def threshold(self, generator: Column) -> Column:
        return F.get(F.array(*(F.lit(t) for t in self.thresholds)), generator)


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """Generated proposals ``generator, label, match, before, fold`` of every generator, with the
    label of the rule that made them."""
    part = lambda salt, k: f"cast(pmod(xxhash64(id, '{salt}'), {k}) as int)"
    text = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    pick = lambda salt, *options: f"element_at(array({', '.join(text(o) for o in options)}), {part(salt, len(options))} + 1)"
    one = lambda salt, *options: f"CASE {part(salt, len(options))} {' '.join(f'WHEN {k} THEN {o}' for k, o in enumerate(options))} END"
    cat = lambda *parts: f"concat({', '.join(parts)})"
    digits = lambda salt, k: f"lpad(cast({part(salt, 10**k)} as string), {k}, '0')"
    some = lambda salt, low, high: f"({low} + {part(salt, high - low + 1)})"
    chars = lambda salt, alphabet, size: f"array_join(transform(sequence(1, {size}), i -> substr({text(alphabet)}, cast(pmod(xxhash64(id, '{salt}', i), {len(alphabet)}) + 1 as int), 1)), '')"
    syllables = ("the", "er", "ion", "la", "ou", "sch", "ment", "ing", "an", "re", "ti", "ver", "os", "al", "el", "queue", "ch", "ma", "no", "st")
    word = lambda salt: f"array_join(transform(sequence(1, {some(salt, 2, 4)}), i -> element_at(array({', '.join(text(s) for s in syllables)}), cast(pmod(xxhash64(id, '{salt}w', i), {len(syllables)}) + 1 as int))), '')"
    words = lambda salt, mark, low, high: f"array_join(transform(sequence(1, {some(salt, low, high)}), j -> array_join(transform(sequence(1, 1 + cast(pmod(xxhash64(id, '{salt}n', j), 3) as int)), i -> element_at(array({', '.join(text(s) for s in syllables)}), cast(pmod(xxhash64(id, '{salt}w', j, i), {len(syllables)}) + 1 as int))), '')), {text(mark)})"
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    title = lambda salt: f"replace(initcap({words(salt, ' ', 2, 5)}), ' ', '')"
    year = pick("year", "1999", "2012", "2019", "2023", "2024")
    plain = lambda salt: one(salt, cat(word(salt + "1"), "' '", word(salt + "2"), "' '"), cat(word(salt + "1"), "', '"), cat(word(salt + "3"), "'. '"), "''", cat(word(salt + "4"), "'\n'"))
    cued = lambda salt, *cues: cat(word(salt + "1"), "' '", pick(salt, *cues))
    against = lambda salt: cued(salt, "order ", "invoice no. ", "isbn ", "part ", "sku ", "serial ", "item ", "ticket ", "model ", "build ")
    secret_cue = lambda salt: one(salt + "c", cued(salt, 'token = "', "key: ", "secret ", "bearer ", "auth=", "api key "), plain(salt))
    area = f"{pick('a1', '2', '3', '4', '6', '7', '8', '9')} || {digits('a2', 2)}"
    exchange = f"{pick('e1', '2', '3', '4', '5', '6', '7', '9')} || {digits('e2', 2)}"
    phone = lambda a: one("form", cat("'('", a, "') '", exchange, "'-'", digits("p3", 4)), cat(a, "'-'", exchange, "'-'", digits("p3", 4)), cat(a, "'.'", exchange, "'.'", digits("p3", 4)), cat(a, "' '", exchange, "' '", digits("p3", 4)), cat("'('", a, "')'", exchange, "'-'", digits("p3", 4)))
    ssn = lambda a: one("sform", cat(a, "'-'", digits("s2", 2), "'-'", digits("s3", 4)), cat(a, "' '", digits("s2", 2), "' '", digits("s3", 4)))
    account = cat(digits("i1", 8), chars("i2", num, some("i3", 3, 12)))
    country = pick("cc", "DE", "FR", "GB", "ES", "IT", "NL", "CH", "PL")
    grouped = lambda x: one("group", x, f"trim(regexp_replace({x}, '(.{{4}})', '$1 '))")
    iban = lambda check: grouped(cat(country, check, account))
    user = one("user", cat(word("u1"), "'.'", word("u2")), word("u1"), cat(word("u1"), digits("u3", 2)))
    at, dot, tld = pick("at", " (at) ", "[at]", " [at] ", "(at)", " at ", "{at}"), pick("dot", ".", " (dot) ", "[dot]", " dot "), pick("tld", "com", "org", "net", "de", "io")
    #: generator, label, match, before, and how the match must look to count
    rows = [
        (0, 1, chars("h", "0123456789abcdef", some("hn", 20, 64)), secret_cue("x1")),
        (0, 1, chars("b", up + low + num + "+/", some("bn", 24, 64)) + " || " + pick("be", "", "=", "=="), secret_cue("x2")),
        (0, 1, chars("u", up + low + num + "_-", some("un", 24, 60)), secret_cue("x3")),
        (0, 1, cat(pick("kp", "AKIA", "ASIA"), chars("k", up + "234567", "16")), secret_cue("x4")),
        (0, 1, cat(pick("gp", "ghp_", "gho_", "sk_live_", "pk_live_", "sk-", "glpat-", "npm_", "AIza"), chars("g", up + low + num, some("gn", 24, 40))), secret_cue("x5")),
        (0, 1, cat("'xoxb-'", digits("xo", 9), "'-'", chars("xp", up + low + num, "24")), secret_cue("x6")),
        (0, 1, cat("'eyJ'", chars("j", up + low + num + "_-", some("jn", 24, 90))), secret_cue("x7")),
        (0, 1, chars("l", up + num, some("ln", 20, 36)), secret_cue("x8")),
        (0, 0, cat(words("w", "-", 3, 9), "'-'", year), plain("y1")),
        (0, 0, cat(words("w", "_", 3, 9), "'_'", digits("w3", 2)), plain("y2")),
        (0, 0, f"upper({words('w', '_', 3, 8)}) || '_' || {digits('w3', 1)}", plain("y3")),
        (0, 0, f"repeat({pick('r', '0', '1', '=-', '0-', '_1', '9=')}, {some('rn', 20, 40)})", plain("y4")),
        (0, 0, cat(words("w", "/", 2, 4), "'/'", year, "'/'", digits("w4", 2), "'/'", words("v", "-", 3, 7)), plain("y5")),
        (0, 0, chars("dn", num, some("dl", 20, 40)), plain("y6")),
        (0, 0, cat(title("w"), title("v"), digits("w5", 1)), plain("y7")),
        (0, 0, cat(word("w"), word("v"), word("z"), word("q"), digits("w6", 2)), plain("y8")),
        (0, 0, chars("h", "0123456789abcdef", one("sha", "32", "40", "64")), cued("y9", "commit ", "sha256 ", "md5 ", "checksum: ", "revision ", "etag ", "digest ")),
        (0, 0, cat(chars("q1", "0123456789abcdef", "8"), "'-'", chars("q2", "0123456789abcdef", "4"), "'-4'", chars("q3", "0123456789abcdef", "3"), "'-a'", chars("q4", "0123456789abcdef", "3"), "'-'", chars("q5", "0123456789abcdef", "12")), one("z0c", plain("z0"), cued("z0", "uuid ", "id "))),
        (0, 0, cat(year, "'-'", digits("t1", 2), "'-'", digits("t2", 2), "'-'", digits("t3", 6), "'-'", digits("t4", 4)), plain("z1")),
        (1, 1, chars("h", "0123456789abcdef", some("cn", 8, 40)), cued("c1", 'token = "', "password: ", "api_key=", "PASSWORD=", "Secret: ")),
        (1, 1, chars("cm", up + low + num + "!#%&*?_-+/", some("co", 8, 24)), cued("c2", 'token="', "password: ", "access_key=", "pwd=", "bearer ")),
        (1, 1, cat(f"initcap({word('w')})", digits("w3", 4), pick("mark", "!", "#", "?", "")), cued("c3", "password: ", "passwd=", 'Password = "')),
        (1, 1, cat(word("w"), digits("w3", 3)), cued("c4", "password=", "pwd: ", "secret=")),
        (1, 0, f"left({word('w')} || {word('v')}, {some('cw', 6, 14)})", cued("d1", "token: ", "password: ", "secret: ", "bearer ")),
        (1, 0, pick("v", "required", "optional", "mandatory", "revoked", "missing", "expired", "invalid", "${TOKEN}", "<password>", "{{token}}", "os.environ[", "process.env.TOKEN", "getToken()", "xxxxxxxx", "********", "undefined", "<your-token>", "YOUR_TOKEN", "changeme", "string,"), cued("d2", "token: ", "password: ", "api_key=", 'secret = "')),
        (1, 0, cat(words("w", "-", 2, 4), pick("de", ",", ".", "")), cued("d3", "token: ", "password: ", "bearer ")),
        (1, 0, cat(words("w", ".", 2, 3), pick("df", "()", ".get(", "[0]", "")), cued("d4", "token = ", "password = ", "api_key=")),
        (2, 1, ssn(f"{pick('sa', '1', '2', '3', '4', '5', '7')} || {digits('s1', 2)}"), one("f1c", cued("f1", "ssn ", "ssn: ", "social security ", "social security number ", "tax id "), plain("f1"))),
        (2, 0, ssn(f"{pick('sb', '9', '9')} || {digits('s1', 2)}"), plain("f2")),
        (2, 0, ssn(pick("sc", "000", "666")), one("f3c", plain("f3"), cued("f3", "ssn ", "social security "))),
        (2, 0, ssn(digits("s1", 3)), against("f4")),
        (3, 1, None, one("g1c", cued("g1", "iban ", "account ", "bank "), plain("g1"))),
        (3, 0, iban(digits("i9", 2)), one("g2c", cued("g2", "serial ", "part ", "build ", "sku ", "iban "), plain("g2"))),
        (4, 1, phone(area), one("h1c", cued("h1", "phone ", "tel ", "call ", "fax ", "reach me at "), plain("h1"))),
        (4, 0, phone(f"{pick('pa', '0', '1')} || {digits('a2', 2)}"), plain("h2")),
        (4, 0, phone(area), against("h3")),
        (4, 0, cat(digits("p1", 3), pick("ps", "-", ".", " "), pick("pe", "0", "1"), digits("p2", 2), "'-'", digits("p4", 4)), plain("h4")),
        (5, 1, cat(user, at, word("host"), dot, tld), one("k1c", cued("k1", "mail ", "contact ", "write to "), plain("k1"))),
        (5, 0, cat(pick("n", "arr", "x", "look"), "'[at]'", digits("d", 1), "'.'", digits("e", 1)), plain("k2")),
        (5, 0, cat(word("w"), "' at '", word("v"), "'.'", pick("kt", "com", "org", "The", "It")), plain("k3")),
    ]
    rows = [(g, y, m or "''", b) for g, y, m, b in rows]
    branch = lambda k: f"CASE rule {' '.join(f'WHEN {i} THEN {r[k]}' for i, r in enumerate(rows))} END"
    each = max(1, n // len(rows))
    made = spark.range(0, each * len(rows), 1, 1).selectExpr("id", f"cast(id div {each} as int) as rule")
    made = made.selectExpr("id", f"{branch(0)} as generator", f"{branch(1)} as label", f"{branch(2)} as match", f"right({branch(3)}, 32) as before", f"{part('fold', 5)} as fold", f"{country} as land", f"{account} as rest")
    check = F.lpad((F.lit(98) - remainder(F.concat("land", F.lit("00"), "rest"))).cast("string"), 2, "0")
    valid = F.concat("land", check, "rest")
    spaced = F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, valid).otherwise(F.trim(F.regexp_replace(valid, "(.{4})", "$1 ")))
    return made.select("generator", "label", F.when(F.col("match") == "", spaced).otherwise(F.col("match")).alias("match"), "before", "fold")


_models: dict[int, Model] = {}


def train(spark: SparkSession, n: int = EXAMPLES) -> Model:
    """Boosted trees for the log loss, and for each generator the lowest threshold that holds the
    precision on the held-out fifth; the same for all calls of a process."""
    if n in _models:
        return _models[n]
    made = examples(spark, n)
    x = features(F.col("generator"), F.col("match"), F.col("before"), F.lit(" "))
    table = made.select("generator", "label", "fold", x.alias("x")).collect()  # about ``n`` rows
    rows = np.array([(r.generator, r.label, r.fold, *r.x) for r in table], float)
    rows = rows[np.lexsort(rows.T)]
    forests, thresholds = [], []
    for g in range(len(GENERATORS)):
        own = rows[rows[:, 0] == g]
        label, held, x = own[:, 1], own[:, 2] == 0, own[:, 3:]
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[:-1])) for f in range(x.shape[1])]
        cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
        bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
        score, trees = np.zeros(len(x)), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            trees.append(_grow(bins[~held], cuts, (p - label)[~held], (p * (1 - p))[~held]))
            score = score + trees[-1].predict(x)
        order = np.argsort(-score[held], kind="stable")
        s, y = score[held][order], label[held][order]
        precise = np.cumsum(y) / np.arange(1, len(y) + 1) >= PRECISION
        good = np.flatnonzero(precise & np.append(s[1:] < s[:-1], True))
        forests.append(trees)
        thresholds.append(round(float(max(s[good[-1]], 0.0)), 6) - 1e-6 if len(good) else float("inf"))
    _models[n] = Model(forests, thresholds)
    return _models[n]


def _meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def selected(spans: Column) -> Column:
    """Spans by falling score, then start and kind, without those that meet one kept before."""
    order = F.transform(spans, lambda s: F.struct((-s["score"]).alias("last"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["rank"].alias("rank")))
    none = F.array().cast("array<struct<last:double,start:int,kind:string,end:int,rank:int>>")
    kept = F.aggregate(F.array_sort(order), none, lambda acc, s: F.when(F.exists(acc, lambda k: _meets(s, k)), acc).otherwise(F.array_append(acc, s)))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), (-s["last"]).alias("score"))).cast(SCORED)


def resolved(spans: Column) -> Column:
    """Base spans and, in each run of spans that overlap, the selected ones of those that meet none."""

    def cluster(own: Column) -> Column:
        return F.when(F.size(own) == 1, own).otherwise(let(F.filter(own, lambda s: s["rank"] < len(KINDS)), lambda base: F.concat(base, selected(F.filter(own, lambda s: (s["rank"] == len(KINDS)) & ~F.exists(base, lambda b: _meets(s, b)))))))

    def parted(rows: Column) -> Column:
        def split(reach: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda k: (k == 0) | (F.get(rows, k)["start"] >= F.get(reach, k - 1)))
            return let(first, lambda cuts: F.flatten(F.transform(cuts, lambda a, k: let(F.transform(F.sequence(a, F.coalesce(F.get(cuts, k + 1), F.size(rows)) - 1), lambda i: F.get(rows, i)), cluster))))

        return let(running(F.transform(rows, lambda s: s["end"]), F.greatest), split)

    alone = F.forall(spans, lambda s: s["rank"] < len(KINDS))
    return F.when(alone, F.array_sort(spans)).otherwise(F.array_sort(let(F.array_sort(spans), parted)))


def spans_of(text: Column, model: Model) -> Column:
    """All spans of a text without marks: ``start, rank, end, kind`` in order."""
    patterns = [("", EMAIL, F.contains(text, F.lit("@"))), ("", IP, text.rlike(r"[0-9]\.[0-9]")), ("", CARD, F.lit(True)), ("", PHONE, text.rlike(r"\+[0-9]")), *((before, pattern, text.rlike(needs)) for _, before, pattern, needs in GENERATORS)]
    in_digits = ("ip", "card", "phone", "ssn", "iban", "local_phone")  # nothing without a digit
    each = lambda digit: F.array(*(F.when(digit & only_if if name in in_digits else only_if, marked(text, before, pattern)) for name, (before, pattern, only_if) in zip(NAMES, patterns)))
    tried = let(text.rlike("[0-9]"), each)
    names = F.array(*(F.lit(n) for n in NAMES))
    base = len(KINDS)

    def kept(found: Column, rank: Column) -> Column:
        row = lambda s, score: F.struct(s["start"].alias("start"), F.least(rank, F.lit(base)).alias("rank"), s["end"].alias("end"), F.get(names, rank).alias("kind"), score.alias("score"))
        good = F.transform(F.filter(found, lambda s: _passes(rank, s["match"])), lambda s: row(s, F.lit(0.0)))
        scored = F.transform(found, lambda s: row(s, model.scored(rank - base, features(rank - base, s["match"], s["before"], s["after"]))))
        return F.when(rank < base, good).otherwise(F.filter(scored, lambda s: s["score"] >= model.threshold(rank - base))).cast(SCORED)

    none = F.array().cast(SCORED)
    every = F.flatten(F.transform(tried, lambda m, rank: F.when(F.contains(m, F.lit(MARK)), let(located(m), lambda found: kept(found, rank))).otherwise(none)))
    placed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))).cast(PLACED)
    return let(every, lambda spans: F.when(F.size(spans) > 0, placed(resolved(spans))).otherwise(F.array().cast(PLACED)))


def detect(df: DataFrame, text_col: str = "text", out: str = "pii", model: Model | None = None) -> DataFrame:
    """``df`` with the column ``out``: an array of (start, rank, end, kind), in order; a rank under
    the number of base kinds is one of them."""
    model = model or train(df.sparkSession)
    clean = f"_clean_{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    unmarked = df.withColumn(clean, F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, STAND_IN)).otherwise(text))
    return unmarked.withColumn(out, spans_of(F.col(clean), model)).drop(clean)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans`` per row."""
    found = detect(spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))))
    count = lambda kind: F.size(F.filter("pii", lambda s: (s["rank"] < len(KINDS)) & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS]
    base = F.filter("pii", lambda s: s["rank"] < len(KINDS))
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span, or union of overlapping spans, replaced by its kind in brackets."""
    names = df.columns
    mark = f"_spans_{uuid.uuid4().hex}"
    text = F.col(text_col)

    def shown(spans: Column, blocks: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            whole = F.array_join(F.slice(blocks, (a / BLOCK).cast("int") + 1, ((b - 1) / BLOCK).cast("int") - (a / BLOCK).cast("int") + 1), "")
            return F.when(b > a, F.substring(whole, a % BLOCK + 1, b - a)).otherwise("")

        def pieces(reach: Column) -> Column:
            at = lambda k: F.when(k == 0, 0).otherwise(F.get(reach, k - 1))
            put = lambda s, k: F.concat(between(at(k), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            changed = F.transform(spans, lambda s, k: F.when(s["start"] >= at(k), put(s, k)).otherwise(""))
            return F.concat(F.array_join(changed, ""), F.substr(text, F.get(reach, F.size(spans) - 1) + 1))

        return let(running(F.transform(spans, lambda s: s["end"]), F.greatest), pieces)

    blocks = F.transform(F.sequence(F.lit(0), (F.char_length(text) / BLOCK).cast("int")), lambda k: F.substring(text, k * BLOCK + 1, F.lit(BLOCK)))
    found = detect(df, text_col, mark)
    return found.withColumn(text_col, F.when(F.size(mark) > 0, let(blocks, lambda b: shown(F.col(mark), b))).otherwise(text)).select(*names)
