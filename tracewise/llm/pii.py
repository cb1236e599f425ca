"""Op 7. Personal data by format-preserving Feistel pseudonyms [native].

Numbers and dates that pass validation are permuted within their own format under a key:
payment cards (Luhn) stay Luhn-valid cards of the same length, phone numbers keep their
country code, count of digits and punctuation, IPv4 addresses, social-security numbers and calendar dates stay
valid ones. The permutation is an unbalanced Feistel network of additions on Z_a x Z_b with
a keyed hash as round function, so it is one-to-one on the format and equal values get equal
pseudonyms in every document. What has no numeric format (mail addresses, secrets) gets a
keyed digest, a secret's being hexadecimal and as long as the secret.

Phone numbers are told by their count of digits: 8 to 15 after a plus sign, ten in North
American groups, nine to eleven in groups after a trunk 0. Secrets are told by the name before
them (token, password, api key ...) or by a known prefix; they need 16 characters of which
eight differ, with letters and digits, or 20 digits.

Main path: DataFrame functions only, no shuffle; a document is rewritten where it is read.

Cases: null text stays null with no findings; empty text stays empty. A number that doesn't
validate is left as it is. Texts without a digit or an at sign are not searched. Repeated
rows are rewritten alike. Extra columns pass through, whatever their names; n_found and
n_replaced replace input columns of these names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm.shared import boxed, let, quoted, unboxed

ROUNDS = 10

# Patterns of what is looked for. None matches the empty string, and none backtracks over a long run.
# A mail's domain gives back whole labels (127 at most, as many as a name can have), so that a full stop after it stays outside.
MAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9][A-Za-z0-9\-]*+(?:\.[A-Za-z0-9\-]++){0,125}\.[A-Za-z]{2,}+"
_VALUE = r"[A-Za-z0-9+/_\-]++(?:\.[A-Za-z0-9+/_\-]++)*+={0,2}"
_NAMED = r"""(?:token|secret|passwd|password|credentials?|(?:api|access|secret|private|auth|signing|encryption)[_\- ]?key)["'`]?\s{0,3}(?::=|=>|[=:])\s{0,3}["'`]?"""
SECRET = (
    rf"(?<![A-Za-z0-9+/_.\-])(?=[A-Za-z0-9+/_.\-]{{16}})(?<=(?i:{_NAMED}|bearer\s{{1,3}})){_VALUE}"
    r"|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}+|github_pat_[A-Za-z0-9_]{30,}+|xox[abeprs]-[A-Za-z0-9\-]{10,}+|sk-[A-Za-z0-9_\-]{20,}+)"
)
_TEN = r"(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}"
PHONE = (
    rf"(?<![\d+])\+(?:\d{{1,3}} \(\d{{3}}\) \d{{3}}-\d{{4}}|1[ .\-]?{_TEN}|[1-9](?:[ .\-/()]{{0,2}}\d){{7,14}})(?!\d)"
    r"|(?<![\p{L}\p{N}+.\-/])(?:1[ .\-])?(?:\([2-9]\d{2}\)[ .\-]?\d{3}[ .\-]\d{4}|[2-9]\d{2}(?:-\d{3}-|\.\d{3}\.| \d{3} )\d{4})(?![\d\-]|\.\d)"
    r"|(?<![\p{L}\p{N}+.\-/])(?:\(0[1-9]\d{0,3}\)[ .\-]?|0[1-9]\d{0,3}[ .\-/])\d(?:[ .\-]?\d){3,8}(?![\d\-]|[./]\d)"
)
DATE = r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])|(?<![\d./])\d{2}/\d{2}/\d{4}(?![\d/])|(?<![\d./])\d{2}\.\d{2}\.\d{4}(?!\d|\.\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
ADDRESS = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
CARD = r"(?<![\d.\-])\d{13,19}(?![\d\-]|\.\d)|(?<![\d\-])\d{4}([ \-])\d{4}\1\d{4}\1\d{4}(?![\d\-])|(?<![\d\-])\d{4}([ \-])\d{6}\2\d{5}(?![\d\-])"


def any_of(*patterns: str) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


FOUND = any_of(MAIL, SECRET, DATE, SSN, ADDRESS, PHONE, CARD)
#: Country codes of one, two and three digits (ITU-T E.164).
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *(p.cast("string") for p in parts)), 256)


def feistel(x: Column, a: int | Column, b: int | Column, key: str, tweak: str | Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the whole numbers below a * b (at most 10^18)."""

    def turn(state: Column, k: Column) -> Column:
        left, right = state["l"], state["r"]

        def mixed(other: Column) -> Column:
            return F.conv(F.substring(keyed(key, F.lit(tweak), k, other), 1, 15), 16, 10).cast("bigint")

        return F.struct(
            F.when(k % 2 == 1, F.pmod(left + F.pmod(mixed(right), F.lit(a)), F.lit(a))).otherwise(left).cast("bigint").alias("l"),
            F.when(k % 2 == 0, F.pmod(right + F.pmod(mixed(left), F.lit(b)), F.lit(b))).otherwise(right).cast("bigint").alias("r"),
        )

    wide = F.lit(b).cast("bigint")

    def permuted(x: Column) -> Column:
        start = F.struct(((x - F.pmod(x, wide)) / wide).cast("bigint").alias("l"), F.pmod(x, wide).cast("bigint").alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, lambda s: s["l"] * wide + s["r"])

    return let(x, permuted)


def digits_permuted(d: Column, most: int, key: str, tweak: Column) -> Column:
    """Digits, most of them at most, to as many digits. One network serves all lengths."""
    n = F.length(d)
    low, high = (F.element_at(F.array(*(F.lit(10**k).cast("bigint") for k in half)), n + 1) for half in ([k // 2 for k in range(most + 1)], [k - k // 2 for k in range(most + 1)]))
    moved = let(F.struct(low.alias("low"), high.alias("high"), tweak.alias("tweak")), lambda v: feistel(d.cast("bigint"), v["low"], v["high"], key, v["tweak"]))
    return F.lpad(moved.cast("string"), n, F.lit("0"))


def luhn_sum(d: Column) -> Column:
    """Luhn sum of a string of digits, its last one being the check digit."""
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        return (total + F.when(i % 2 == 1, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))).cast("int")

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def card(m: Column, key: str) -> Column:
    """A Luhn-valid number of the same length and grouping; anything else as it is."""

    def grouped(v: Column) -> Column:
        full, gap = v["full"], v["gap"]

        def parted(*sizes: int) -> Column:
            starts = [1 + sum(sizes[:k]) for k in range(len(sizes))]
            return F.concat_ws("", *(x for k, (a, size) in enumerate(zip(starts, sizes, strict=True)) for x in ([gap] if k else []) + [F.substring(full, a, size)]))

        return F.when(gap == "", full).when(v["n"] == 15, parted(4, 6, 5)).otherwise(parted(4, 4, 4, 4))

    def of(d: Column) -> Column:
        n = F.length(d)
        moved = let(F.substring(d, F.lit(1), n - 1), lambda body: digits_permuted(body, 18, key, F.concat(F.lit("card"), n.cast("string"))))

        def checked(moved: Column) -> Column:
            return F.concat(moved, F.pmod(10 - F.pmod(luhn_sum(F.concat(moved, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))

        new = let(F.struct(let(moved, checked).alias("full"), F.regexp_extract(m, r"[ \-]", 0).alias("gap"), n.alias("n")), grouped)
        return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, new).otherwise(m)

    return let(F.regexp_replace(m, r"\D", ""), of)


def phone(m: Column, key: str) -> Column:
    """The digits after the country code are permuted among those of the same count, in the punctuation they have."""
    written = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .\-/(])|^1[ .\-](?=\(?\d{3}[) .\-])", 0)
    head = let(written, lambda written: F.when(written == "", F.regexp_extract(m, COUNTRY, 0)).otherwise(written))

    def put(state: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(state["s"], F.when(digit, F.substring(state["d"], F.lit(1), F.lit(1))).otherwise(c)).alias("s"), F.when(digit, F.substring(state["d"], F.lit(2), F.length(state["d"]))).otherwise(state["d"]).alias("d"))

    def of(head: Column, rest: Column) -> Column:
        def moved(d: Column) -> Column:
            n = F.length(d)
            return digits_permuted(d, 14, key, F.when(n == 10, "phone").otherwise(F.concat(F.lit("phone"), n.cast("string"))))

        start = F.struct(head.alias("s"), let(F.regexp_replace(rest, r"\D", ""), moved).alias("d"))
        return F.aggregate(F.split(rest, "(?!^)"), start, put, lambda s: s["s"])

    return let(head, lambda head: let(F.substring(m, F.length(head) + 1, F.length(m)), lambda rest: of(head, rest)))


def secret(m: Column, key: str) -> Column:
    """A digest as long as what it stands for; words and repeated characters as they are."""
    n = F.length(m)
    digest = F.substring(F.repeat(keyed(key, F.lit("secret"), m), F.ceil(n / 64).cast("int")), F.lit(1), n)
    varied = m.rlike("[0-9]") & (F.size(F.array_distinct(F.split(m, ""))) >= 8)
    return F.when(varied, F.when(m.rlike("^[0-9A-F]+$"), F.upper(digest)).otherwise(digest)).otherwise(m)


def address(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    x = F.aggregate(parts, F.lit(0).cast("bigint"), lambda t, p: t * 256 + p)
    out = let(feistel(x, 65536, 65536, key, "ipv4"), lambda y: F.concat_ws(".", *(F.pmod(F.shiftright(y, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0))))
    return F.when(F.forall(parts, lambda p: p <= 255), out).otherwise(m)


def ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    x = (F.when(area > 666, area - 2).otherwise(area - 1).cast("bigint") * 99 + group - 1) * 9999 + serial - 1

    def written(y: Column) -> Column:
        s = F.pmod(y, F.lit(9999)) + 1

        def of(rest: Column) -> Column:
            g = F.pmod(rest, F.lit(99)) + 1
            a = let(((rest - g + 1) / 99).cast("bigint") + 1, lambda a: F.when(a >= 666, a + 1).otherwise(a))
            return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad(g.cast("string"), 2, "0"), F.lpad(s.cast("string"), 4, "0"))

        return let(((y - s + 1) / 9999).cast("bigint"), of)

    return F.when(valid, let(feistel(x, 898, 99 * 9999, key, "ssn"), written)).otherwise(m)


def date(m: Column, key: str) -> Column:
    """Days of the 400 years from 1800 on are 189 x 773; other dates are left as they are."""
    first = F.to_date(F.lit("1800-01-01"))
    forms = {"-": "yyyy-MM-dd", "/": "MM/dd/yyyy", ".": "dd.MM.yyyy"}

    def by_form(use) -> Column:
        return reduce(lambda c, mark: c.when(m.contains(mark), use(forms[mark])), "/.", F.when(m.contains("-"), use(forms["-"])))

    def of(day: Column, n: Column) -> Column:
        to = F.date_add(first, feistel(n, 189, 773, key, "date").cast("int"))
        valid = (n >= 0) & (n < 189 * 773) & (by_form(lambda form: F.date_format(day, form)) == m)
        return F.when(valid, let(to, lambda x: by_form(lambda form: F.date_format(x, form)))).otherwise(m)

    return let(by_form(lambda form: F.try_to_date(m, form)), lambda day: let(F.datediff(day, first).cast("bigint"), lambda n: of(day, n)))


def mail(m: Column, key: str) -> Column:
    return F.concat(F.lit("user"), F.substring(keyed(key, F.lit("mail"), F.lower(m)), 1, 16), F.lit("@example.org"))


def pseudonym(m: Column, key: str) -> Column:
    """What a finding is replaced with; the finding itself where it doesn't validate."""
    return (
        F.when(m.contains("@"), mail(m, key))
        .when(m.rlike("[A-Za-z]|^[0-9]{20,}$"), secret(m, key))
        .when(m.rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{2}[/.]\d{2}[/.]\d{4}$"), date(m, key))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), ssn(m, key))
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), address(m, key))
        .when(m.startswith("+") | ~m.rlike(f"^(?:{CARD})$"), phone(m, key))
        .otherwise(card(m, key))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counts: bool = True) -> DataFrame:
    """docs with the text rewritten, and n_found, n_replaced (not with counts=False)."""
    t = F.col("text")
    pieces, found = F.split(t, FOUND, -1), F.regexp_extract_all(t, F.lit(FOUND), F.lit(0))
    done = F.struct(
        pieces.alias("pieces"),
        F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new"))).alias("found"),
    )
    searched = boxed(docs, text=F.col(quoted(text))).withColumn("p", F.when(t.rlike("[0-9@]") & t.rlike(FOUND), done))
    joined = F.array_join(F.flatten(F.zip_with("p.pieces", "p.found", lambda x, m: F.array(x, F.coalesce(m["new"], F.lit(""))))), "")
    new = {text: F.when(F.col("p").isNotNull(), joined).otherwise(t)}
    if counts:
        new["n_found"] = F.coalesce(F.size("p.found"), F.lit(0)).cast("bigint")
        new["n_replaced"] = F.coalesce(F.size(F.filter("p.found", lambda m: m["old"] != m["new"])), F.lit(0)).cast("bigint")
    return unboxed(searched, docs.columns, **new)
