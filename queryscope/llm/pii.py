"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Everything is a column expression over one row, so a document is never shuffled.
Offsets count code points and ends are exclusive. A null text is an empty text;
it has no spans. Equal rows give equal results. The caller's other columns are
not read, so their names cannot clash.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# code points read on either side of a candidate, up to the next candidate of its kind
CONTEXT = 48
# running sums work on pieces of this many numbers, so that long arrays stay cheap
_PIECE = 256
_SPAN = "array<struct<kind:string,start:int,end:int,score:double,checked:boolean>>"


@dataclass(frozen=True)
class Kind:
    """A sort of personal data.

    ``pattern`` proposes candidates, ``check`` drops those a checksum or bound
    refutes, ``base`` is the score of one that stays, ``near`` are words that raise
    it by ``gain``. A candidate is a span when its score reaches ``floor``.
    """

    name: str
    pattern: str
    check: Callable[[Column], Column] | None
    base: float
    near: str
    gain: float = 0.1
    floor: float = 0.5
    needs: str = "[0-9]"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """13 to 19 digits with a right Luhn digit."""
    digits = _digits(c)
    return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(False)


def mod97(c: Column) -> Column:
    """The account number's country and check digits moved to the end give 1 modulo 97."""
    plain = F.regexp_replace(c, " ", "")
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))

    def step(acc, ch):
        code = F.ascii(ch)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(step(acc, ch))) == 1)


def ip_parts(c: Column) -> Column:
    """Four numbers, each at most 255."""
    return c.rlike(r"^0*+(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)(\.0*+(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)){3}$") & ~c.rlike("(^|[.])0*+[3-9][0-9][0-9]")


def phone_digits(c: Column) -> Column:
    return F.length(_digits(c)).between(9, 15)


def mixed_value(c: Column) -> Column:
    """The value behind the sign has letters and digits: a name, a sentence or a plain number is no secret."""
    value = F.regexp_extract(c, r"[:=]>?[\x20\t]{0,4}[\"']?+(.++)$", 1)
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]")


def varied_hex(c: Column) -> Column:
    """At least ten different characters, as random digits have; a ruler or a padded number has fewer."""
    return F.size(F.array_distinct(F.split(c, ""))) >= 10


# Runs are possessive and start where a run starts or where the last match ended: the same
# matches as the plain patterns, in linear time and without recursion on texts of any length.
KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, 0.9, r"(?i)\b(e-?mail|contact|write|correo|courriel|kontakt)\b", needs="@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", ip_parts, 0.6, r"(?i)\b(ip|address|host|server|client|login)\b"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", luhn, 0.8, r"(?i)\b(card|visa|credit|payment|karte|tarjeta|carte)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", phone_digits, 0.7, r"(?i)\b(phone|tel|call|mobile|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)\b", needs="[+]"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", mod97, 0.8, r"(?i)\b(iban|account|bank|konto|cuenta|compte)\b", needs="[A-Z]{2}[0-9]{2}"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", None, 0.4, r"(?i)\b(ssn|social security|tax id)\b", gain=0.3, needs="[0-9]{3}-"),
    Kind("secret", r"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|(?:api|access|private|auth)[_-]?key|credential)s?[\"']?[\x20\t]{0,4}[:=]>?[\x20\t]{0,4}[\"']?[A-Za-z0-9+/_.~=-]{8,}+", mixed_value, 0.8, r"(?i)\b(login|auth|bearer|admin|user)\b", needs="(?i)(token|secret|passw|passphrase|pwd|key|credential)[^\n]{0,8}[:=]"),
    Kind("key_block", r"-----BEGIN\x20(?:[A-Z0-9]{1,12}\x20){0,3}PRIVATE\x20KEY-----", None, 0.9, r"(?i)\bkey\b", needs="PRIVATE KEY-----"),
    Kind("access_key", r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++)(?![A-Za-z0-9])", None, 0.8, r"(?i)\b(key|token|bearer)\b", needs="AKIA|ASIA|gh[pousr]_|eyJ"),
    Kind("hex_secret", r"(?<![A-Za-z0-9]|[:=]|[:=][\x20\"']|[:=]\x20[\"'])[0-9a-f]{32,}+(?![A-Za-z0-9])", varied_hex, 0.4, r"(?i)\b(token|secret|key|password|bearer|auth)\b", gain=0.3, needs="[0-9a-f]{32}"),
]
SECRETS = ["secret", "key_block", "access_key", "hex_secret"]
BASE = ["email", "ip", "card", "phone"]


def running_sum(arr: Column) -> Column:
    """Sums of an int array up to each place: by pieces, then their totals."""

    def sums(a):
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
        add = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["all"], acc["sum"] + x).alias("all"))
        return F.aggregate(a, start, add, lambda acc: acc["all"])

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / _PIECE).cast("int")), lambda b: sums(F.slice(arr, b * _PIECE + 1, _PIECE)))
    shifts = lambda p: F.concat(F.array(F.lit(0)), sums(F.transform(p, lambda w: F.element_at(w, -1))))
    whole = F.aggregate(F.array(pieces), F.array().cast("array<int>"), lambda _, p: F.flatten(F.zip_with(p, F.slice(shifts(p), 1, F.size(p)), lambda w, s: F.transform(w, lambda x: x + s))))
    return F.when(F.size(arr) > 0, whole).otherwise(F.array().cast("array<int>"))


def find_spans(df: DataFrame, text: str = "text", keep: list[str] | None = None, kinds: list[Kind] = KINDS) -> DataFrame:
    """``keep`` columns and ``spans``: kind, start, end, score, checked, by kind as listed and then by start.

    Matches are leftmost and do not overlap within a kind; a candidate that its
    check refutes is dropped and not tried again at another place.
    """
    keep = keep or []
    given = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    held = [f"k{i}" for i in range(len(keep))]
    df = df.select(*given, F.coalesce(F.col(text), F.lit("")).alias("t"))
    none = F.array().cast("array<string>")
    found = [F.when(F.col("t").rlike(k.needs), F.regexp_extract_all("t", F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"m{i}") for i, k in enumerate(kinds)]
    df = df.select(*held, "t", *found)
    # what lies between the matches gives their places and the words nearby
    between = [F.when(F.size(f"m{i}") > 0, F.split("t", k.pattern, -1)).otherwise(none).alias(f"g{i}") for i, k in enumerate(kinds)]
    df = df.select(*held, *[f"m{i}" for i in range(len(kinds))], *between)
    ends = []
    for i in range(len(kinds)):
        m, g = F.col(f"m{i}"), F.col(f"g{i}")
        ends.append(running_sum(F.zip_with(m, F.slice(g, 1, F.size(m)), lambda x, y: F.length(x) + F.length(y))).alias(f"e{i}"))
    df = df.select("*", *ends)
    spans = [_accepted(k, F.col(f"m{i}"), F.col(f"g{i}"), F.col(f"e{i}")) for i, k in enumerate(kinds)]
    return df.select(*[F.col(h).alias(c) for h, c in zip(held, keep)], F.concat(*spans).alias("spans"))


def _accepted(k: Kind, matches: Column, gaps: Column, ends: Column) -> Column:
    def one(m, i):
        before, after = F.right(F.get(gaps, i), F.lit(CONTEXT)), F.left(F.get(gaps, i + 1), F.lit(CONTEXT))
        score = F.lit(k.base) + F.when(before.rlike(k.near) | after.rlike(k.near), k.gain).otherwise(0.0)
        end = F.get(ends, i)
        return F.struct(F.lit(k.name).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score"), F.lit(k.check is not None).alias("checked"), m.alias("m"))

    kept = F.filter(F.transform(matches, one), lambda s: (s["score"] >= k.floor) & (k.check(s["m"]) if k.check else F.lit(True)))
    return F.transform(kept, lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "score", "checked")])).cast(_SPAN)


def digest(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: counts of the four base kinds, the hash of their spans, all spans as text, the number of secrets, and whether there is any span."""
    df = find_spans(df, text, [key])
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    of = lambda names: F.filter("spans", lambda s: s["kind"].isin(names))
    joined = lambda a: F.array_join(F.transform(a, line), ",")
    return df.select(
        key, *[F.size(of([n])).cast("long").alias(f"n_{n}") for n in BASE],
        F.sha2(joined(of(BASE)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(of(SECRETS)).cast("long").alias("n_secret"), (F.size("spans") > 0).alias("found"),
    )
