"""PII by anchor expansion: Aho-Corasick finds anchors, deterministic local parsers expand and validate around them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


KINDS = ("email", "ip", "card", "phone", "address", "account")
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "sftp://", "ssh://", "mailto:", "www.")
CUES = ("account", "acct", "iban", "ssn", "passport", "token", "secret", "api_key", "api-key", "apikey", "access_key")
PASSWORD_CUES = ("password", "passwd", "pwd")
#: Cues whose value need not look like a number: behind a colon or an equals sign it is a secret.
SECRET_CUES = ("token", "secret", "api_key", "api-key", "apikey", "access_key")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WIDE_LEFT = re.compile(r"[\w.%+-]")
_WIDE_DOMAIN = re.compile(r"\w[\w-]*(?:\.\w[\w-]*)+")
_BODY = re.compile(r"[^\s<>\"'`{}|\\^]+")
#: Between the end of a cue and its identifier there are at most so many characters; the identifier has no upper bound.
_LEAD = 16
_ID = re.compile(r"s?[\x20\t]{0,2}(?:(?:no|nr|number|id)\.?[\x20\t]{0,2})?[:=#]?[\x20\t]{0,2}[\"']?([A-Za-z0-9](?:[A-Za-z0-9_+/-]|[\x20](?=[0-9A-Z]{2,4}(?:[\x20]|\b))){4,}[A-Za-z0-9])")

_VALUE = re.compile(r"[\"']?[\x20\t]{0,2}[:=][\x20\t]{0,2}[\"']?([^\s\"'<>,;()\[\]{}]{6,})")
_TOKEN_RUN = re.compile(r"[A-Za-z0-9_-]*")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{6,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str, ats: list[int]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain patterns, leftmost and non-overlapping for each kind; failing ones drop.

    `ats` are the places of the at-signs, the anchors of emails.
    """
    out = []
    done = 0
    for at in ats:  # the run of local characters before an at-sign is the only place where a match can begin
        if at < done:
            continue
        start = at
        while start > done and _LOCAL.match(text, start - 1, start):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), "email"))
            done = found.end()
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            pos, parts = m.start(), m.group().split(".")
            for i in range(0, len(parts) - 3, 4):
                some = parts[i : i + 4]
                end = pos + sum(map(len, some)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in some):
                    out.append((pos, end, "ip"))
                pos = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((*m.span(), "phone"))
    return out


def anchors():
    """The automaton of at-signs, schemes and identifier cues; anchors are in lower case."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("@", ("@",)), ("scheme", SCHEMES), ("cue", CUES), ("password", PASSWORD_CUES), ("jwt", ("eyj",))):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def secret_value(text: str, end: int, kind: str) -> tuple[int, int] | None:
    """The value behind a secret's cue and a colon or an equals sign: of a password anything of six characters, of others
    what holds a digit or has sixteen."""
    m = _VALUE.match(text, end)
    if not m:
        return None
    stop = m.end(1)
    while stop > m.start(1) and text[stop - 1] in ".!?:":
        stop -= 1
    value = text[m.start(1) : stop]
    good = len(value) >= 6 and (kind == "password" or len(value) >= 16 or any(c.isdigit() for c in value))
    return (m.start(1), stop) if good else None


def expanded_spans(text: str, lowered: str, found: list[tuple[int, tuple[str, int]]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that the anchors add: addresses behind schemes, identifiers and secrets behind cues, emails in other scripts.

    `lowered` is the text in lower case, with places that agree; `found` are its anchors as (last place, (kind, size)).
    """
    out = []
    done = {"address": 0, "account": 0, "email": 0}
    dull = 0  # end of a run without four digits: identifiers that begin inside it end with it and have no more
    no_token = 0  # end of a run at which a token failed
    mails, mail = sorted(s[:2] for s in base if s[2] == "email"), 0
    for last, (kind, size) in found:
        start, end = last + 1 - size, last + 1
        if kind == "@":
            while mail < len(mails) and mails[mail][1] <= start:
                mail += 1
            if (mail < len(mails) and mails[mail][0] <= start) or start < done["email"]:
                continue
            left, right = start, _WIDE_DOMAIN.match(text, end)
            while right and left > done["email"] and _WIDE_LEFT.match(text, left - 1, start):
                left -= 1
            if left < start and right:
                tail = right.group().rsplit(".", 1)[1]
                a = start - len(text[left:start].lstrip(".%+-"))
                if a < start and len(tail) >= 2 and tail.isalpha():
                    out.append((a, right.end(), "email"))
                    done["email"] = right.end()
        elif kind == "scheme":
            if start < done["address"] or (start and (text[start - 1].isalnum() or text[start - 1] in "./")):
                continue
            body = _BODY.match(text, end)
            if not body:
                continue
            stop = body.end()
            while stop > end and text[stop - 1] in ".,;:!?)]*":  # closing marks belong to the sentence
                stop -= 1
            host = re.split(r"[/?#]", text[end:stop], maxsplit=1)[0]
            if "." in host.strip(".") or "@" in host or (host and "://" in lowered[start:end]):
                out.append((start, stop, "address"))
                done["address"] = stop
        elif kind == "jwt":
            if start < max(done["account"], no_token) or not text.startswith("eyJ", start):
                continue
            m = _JWT.match(text, start)
            if m:
                out.append((*m.span(), "account"))
                done["account"] = m.end()
            else:  # a token that begins inside the same run ends it at the same place and fails alike, or is shorter
                no_token = _TOKEN_RUN.match(text, start).end()
        else:
            if start < done["account"] or (start and text[start - 1].isalnum()):
                continue
            value = secret_value(text, end, kind) if kind == "password" or lowered[start:end] in SECRET_CUES else None
            if value:
                out.append((*value, "account"))
                done["account"] = value[1]
                continue
            if kind == "password" or end + _LEAD < dull:
                continue
            m = _ID.match(text, end)
            if m and sum(c.isdigit() for c in m.group(1)) >= 4:
                out.append((*m.span(1), "account"))
                done["account"] = m.end(1)
            elif m:
                dull = m.end(1)
    return out


_UPPER = {c: c + 32 for c in range(65, 91)}


def all_spans(text: str | None, automaton) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start and then by kind."""
    text = text or ""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    lowered = text.lower()
    if len(lowered) != len(text):  # a few letters grow in lower case
        lowered = text.translate(_UPPER)
    found = list(automaton.iter(lowered))
    base = base_spans(text, [last for last, (kind, _) in found if kind == "@"])
    more = expanded_spans(text, lowered, found, base)
    return sorted(base, key=order), sorted([*base, *more], key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a mark for the kind in place of each span; spans that overlap become one mark, of the first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _find(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            cols: list[list] = [[] for _ in range(9 if with_text else 8)]
            for text in batch.column(0).to_pylist():
                base, every = all_spans(text, automaton)
                for c, kind in zip(cols, KINDS[:4], strict=False):
                    c.append(sum(s[2] == kind for s in base))
                cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[5].append(joined(every))
                for c, kind in zip(cols[6:8], KINDS[4:], strict=True):
                    c.append(sum(s[2] == kind for s in every))
                if with_text:
                    cols[8].append(redacted(text, every) if every else text)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()]
            names = [*[f"n_{k}" for k in KINDS[:4]], "base_sha256", "spans", "n_address", "n_account", "clean_text"]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, types, strict=False)], *batch.columns[1:]], names=[*names[: len(cols)], *batch.schema.names[1:]])

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), redact: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_address, n_account, clean_text if `redact`, columns in
    `keep`).

    The first counts and the hash are of the base spans; `spans` holds these and what the anchors add, which the last
    counts are of (kinds address and account, the latter for identifiers and secrets), and emails in other scripts. Places are code points, ends exclusive. One pass over the rows, without
    a shuffle. A null text has no spans and stays null; repeated rows, null ids and extra columns pass through. Very long
    texts are read whole, in time that grows with their length. Ties in place go to the first kind. Empty in, empty out.
    """
    given = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long").alias("_id"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    schema = ["n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_address long, n_account long", *["clean_text string"] * redact, "_id long", *[f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]]
    out = given.mapInArrow(_find(redact), ", ".join(schema))
    return out.select(F.col("_id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_address", "n_account", *["clean_text"] * redact, *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])
