"""Personal data by anchor expansion: an Aho-Corasick pass finds at-signs, schemes, digits and identifier
cues; small parsers expand each anchor to the boundaries of an address or account and validate it."""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
ADDED = ("login", "iban", "ssn", "account", "secret")
KINDS = BASE + ADDED
#: The cues of identifiers, in lower case, and the kind that each announces.
CUES = {
    "iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "konto": "account", "cuenta": "account", "compte": "account",
    "password": "password", "passwd": "password", "pwd": "password", "passwort": "password", "token": "key", "secret": "key", "api_key": "key", "api key": "key", "apikey": "key", "access_key": "key", "akia": "akia",
}

_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_LETTER = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_RUN = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[^\s/:@]++:[^\s/@]++@[A-Za-z0-9.-]++")
#: What may stand between a cue and its number: a word for "number", a verb, a sign.
_LINK = r"(?i:[ -]?(?:number|nummer|num\.?|no\.?|nr\.?))?(?i: (?:is|ist|est|es))?[ ]?[:#=]?[ ]{0,2}"
_AFTER = {
    "iban": re.compile(_LINK + r"([A-Za-z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+)(?![A-Za-z0-9])"),
    "ssn": re.compile(_LINK + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
    "account": re.compile(_LINK + r"([0-9]{8,20}+)(?![0-9])"),
}
#: The value that a password's or key's cue assigns: to the closing quote, or to white space; trailing stops don't belong to it.
_VALUE = re.compile(r"""(?i:[ _]?(?:is|ist))?[ ]?[:=]?[ ]?(?:"([^"\s]++)"|'([^'\s]++)'|([^\s"']++))""")
_KEY = re.compile(r"[A-Za-z0-9_./+=-]{16,}+")
_AKIA = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, (1, "digit"))
        found.add_word("+" + c, (2, "phone"))
    found.add_word("@", (1, "email"))
    found.add_word("://", (3, "login"))
    for cue in CUES:
        found.add_word(cue, (len(cue), cue))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _iban(shown: str) -> str | None:
    """The longest start of what follows a cue, up to a space or its end, that is a valid account number."""
    while shown:
        packed = shown.replace(" ", "").upper()
        if 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1:
            return shown
        shown = shown.rpartition(" ")[0]
    return None


def _secret(what: str, text: str, after: int) -> tuple[int, int | None]:
    """Where the value that a cue assigns ends for the parser, and where the secret ends, if it is one.

    A cue that assigns nothing (no sign, no verb) announces nothing; a password has a digit and six characters, a key
    a digit, sixteen characters and none but those of encoded bytes.
    """
    m = _VALUE.match(text, after)
    if not m or not text[after : m.start(m.lastindex)].strip(" \"'"):
        return after, None
    value, end = m[m.lastindex], m.end()
    if m.lastindex == 3:
        value = value.rstrip(".,;:!?)")
        end = m.start(3) + len(value)
    good = any(map(str.isdigit, value)) and (len(value) >= 6 if what == "password" else bool(_KEY.fullmatch(value)))
    return m.end(), end if good else None


def spans(text: str) -> list[tuple[str, int, int]]:
    """The (kind, start, end) of a text's personal data, by kind as in KINDS, then start; code points, end exclusive."""
    found: dict[str, list[tuple[int, int]]] = {}
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = text.translate(_LOWER)
    mail_end = run_end = card_end = value_end = 0
    for last, (size, what) in _anchors().iter(low):
        at = last + 1 - size
        if what == "digit":
            if at >= run_end:  # the first digit of a run that no address has taken
                if m := _IP.match(text, at):
                    run_end = m.end()
                    if all(map(_octet, m[0].split("."))):
                        found.setdefault("ip", []).append(m.span())
                else:
                    run_end = _RUN.match(text, at).end()
            if at >= card_end:
                if m := _CARD.match(text, at):
                    card_end = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found.setdefault("card", []).append(m.span())
                else:
                    card_end = at + 1
        elif what == "email":
            start = at
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                mail_end = m.end()
                found.setdefault("email", []).append((start, mail_end))
        elif what == "phone":
            if (m := _PHONE.match(text, at)) and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.setdefault("phone", []).append(m.span())
        elif what == "login":
            start = at
            while start and text[start - 1] in _LETTER:  # no letter is an anchor's, so no letter is read twice
                start -= 1
            if start < at and (m := _LOGIN.match(text, at)):
                found.setdefault("login", []).append((start, m.end()))
        elif at and text[at - 1].isalnum():
            continue  # a cue within a word
        elif what == "akia":
            if m := _AKIA.match(text, at):
                found.setdefault("secret", []).append(m.span())
        elif CUES[what] in ("password", "key"):
            if at >= value_end:  # else the cue is part of a value that was read
                value_end, end = _secret(CUES[what], text, last + 1)
                if end:
                    found.setdefault("secret", []).append((at, end))
        elif m := _AFTER[CUES[what]].match(text, last + 1):
            shown = _iban(m[1]) if CUES[what] == "iban" else m[1]
            if shown:
                found.setdefault(CUES[what], []).append((m.start(1), m.start(1) + len(shown)))
    return [(k, *s) for k in KINDS if k in found for s in sorted(set(found[k]))]


def _shown(found) -> str:
    return ",".join([f"{k}:{s}:{e}" for k, s, e in found])


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Every whole text is read once, in place, without a shuffle. A null or empty text has no spans: its
    counts are 0 and base_sha256 is that of the empty string. Repeated rows are read row by row; columns
    other than doc_id and text are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def rows(batch):
        out = [[] for _ in schema.names[1:]]
        for text in batch.column(1).to_pylist():
            found = spans(text or "")
            base = [x for x in found if x[0] in BASE]
            for column, value in zip(out, [*(sum(x[0] == k for x in base) for k in BASE), sha256(_shown(base).encode()).hexdigest(), _shown(found), len(found) - len(base)]):
                column.append(value)
        return [batch.column(0), *out]

    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.batches(rows, schema), ddl)


def masked(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    if not text:
        return text
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans(text)):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``n_chars``, if there, as long as that; null texts stay null, other columns as they are."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(masked, na_action="ignore")

    out = docs.withColumn("text", mask("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
