"""Personal data in texts, plain and disguised, with spans in source characters.

Plain identifiers are found in the text as it stands.  Disguised ones are found
after a chain of transducers has rewritten the text: look-alike characters,
spelled digits, and words for "at" and "dot".  Each transducer keeps, for every
character it writes, the source characters it came from, so that spans found in
the rewritten text lead back to the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The four patterns.  The look-behind of ip and the possessive
# repeats change nothing but the time that failing attempts take.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find(text: str) -> list[Span]:
    """The plain identifiers, leftmost and without overlap within a kind."""
    out: list[Span] = []
    if "@" in text:
        before = 0
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > before and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                before = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _lookalikes() -> dict[int, str]:
    """Characters that stand for one ASCII character: compatibility forms by Unicode's rule, and letters of other scripts with the same shape."""
    table = {}
    for c in range(0x80, 0x20000):
        plain = unicodedata.normalize("NFKC", chr(c))
        if len(plain) == 1 and "!" <= plain <= "~":
            table[c] = plain
        if unicodedata.category(chr(c)) == "Nd":  # digits of other scripts
            table[c] = str(unicodedata.digit(chr(c)))
    # Cyrillic and Greek letters and the Latin ones they look like.
    table |= dict(zip(map(ord, "авеіјкмнорсԁѕтухһԛԝАВЕІЈКМНОРСЅТУХ"), "abeijkmhopcdstyxhqwABEIJKMHOPCSTYX"))
    table |= dict(zip(map(ord, "αεινορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"), "aeivoptuxABEZHIKMNOPTYX"))
    return table | dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD), "")


LOOKALIKES = _lookalikes()
_ODD = frozenset(map(chr, LOOKALIKES))

# Words for the digits in English, German, French and Spanish.
DIGIT_WORDS = {
    w: str(i % 10)
    for names in (
        "zero one two three four five six seven eight nine",
        "oh",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, w in enumerate(names.split())
}
_DIGIT_WORD = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + r"|plus)(?![^\W_])", re.IGNORECASE)
#: Single digits with a space between each.
_SPELLED_RUN = re.compile(r"(?<![0-9] )(?<![0-9])[0-9](?: [0-9])+(?![0-9]| [0-9])")
_GAP_CHARS = " \t\n().,;:-"
_GAP = re.compile(r"[\s().,;:-]{0,3}")

_OPEN, _CLOSE = r"[\[({<]\s*", r"\s*[\])}>]"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
#: Last labels that let a bare " at " before a plain domain be read as part of an address; a spelled or bracketed dot before the last label needs none.
_ENDINGS = "com|org|net|edu|gov|info|io|co|uk|de|fr|es|eu|example|test"
_LAST = rf"(?:{_ENDINGS})(?![A-Za-z0-9])"
_AT, _DOT = r"(?:at|arroba|arobase|klammeraffe|ät|a|@)", r"(?:dot|punkt|punto|point|\.)"
_BARE_AT = r"(?:at|arroba|arobase|klammeraffe)"
_HIDDEN_DOT = rf"(?:\s*{_OPEN}{_DOT}{_CLOSE}\s*|\s+(?:dot|punkt|punto)\s+)"
_DOT_MARK = re.compile(rf"(?<=[A-Za-z0-9])(?:{_HIDDEN_DOT})(?=[A-Za-z0-9])", re.IGNORECASE)
#: Words before "dot" that make it a noun; such a domain needs one of the last labels above.
_NOUN = r"(?:the|an?|this|that|each|every|any|one|no|his|her|its|my|our|your|their|der|dem|den|einem|jedem|el|un|le|il|al)"
_NOT_NOUN = rf"(?!{_NOUN}\s+(?:dot|punkt|punto)\s)"
_PLAIN_OR_LISTED = rf"{_NOT_NOUN}(?!www\.){_LABEL}(?:(?:{_HIDDEN_DOT}|\.){_LABEL})*(?:{_HIDDEN_DOT}|\.){_LAST}"
_SPELLED = rf"{_NOT_NOUN}{_LABEL}(?:(?:{_HIDDEN_DOT}|\.){_LABEL})*{_HIDDEN_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9])"
_AT_MARK = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?:\s*{_OPEN}{_AT}{_CLOSE}\s*(?={_LABEL})|\s+{_BARE_AT}\s+(?={_PLAIN_OR_LISTED}|{_SPELLED}))", re.IGNORECASE)
#: Signs written between underscores, as in jane_at_example_dot_com.
_UNDERSCORED = re.compile(r"(?<=[A-Za-z0-9])_at_(?=[A-Za-z0-9-]+(?:(?:_dot_|\.)[A-Za-z0-9-]+)*_dot_[A-Za-z]{2,}(?![A-Za-z0-9]))|(?<=[A-Za-z0-9])_dot_(?=[A-Za-z0-9])", re.IGNORECASE)
#: Words that go with "at" in prose; as the whole name before a bare "at" they make no address.
_BEFORE_AT = frozenset(
    "it us me them him her you we they i he she this that these those one all more less most first last best worst least only just not now here there then again back up down out in on off over around away home"
    " is are was were be been being am look looks looked looking arrive arrives arrived arriving stay stays stayed staying meet meets met meeting meetings visit visits visited find finds found see sees saw seen"
    " live lives lived living work works worked working start starts started starting begin begins began end ends ended stop stops stopped aim aims aimed point points pointed laugh laughed smile smiled shout shouted"
    " wait waits waited sit sat stand stood sell sells sold buy bought buying available located based hosted held online news article articles page pages site website sites shop store event events conference"
    " read reads more posted published listed shown apply register registered sign join joined contact good bad better expert students people team staff open opens opened sale sales dinner lunch party night day noon".split()
)


def _named(text: str, mark: re.Match) -> bool:
    """Whether what stands before an at mark can be an address's name: before a bare word it is no word that prose puts there."""
    if not mark[0].strip().isalpha():
        return True
    start = mark.start()
    while start and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
        start -= 1
    return text[start : mark.start()].lower() not in _BEFORE_AT


class Aligned:
    """A rewritten text; character i of it stands for source characters first[i] to last[i], the end not included."""

    def __init__(self, text: str):
        self.text, self.first, self.last, self.changed = text, [], [], []  # the lists stay empty up to the first edit

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Put each (start, end, new) in place; edits are in order and apart.  A new text stands for all that it replaces."""
        if not edits:
            return
        if not self.first:
            n = len(self.text)
            self.first, self.last, self.changed = list(range(n)), list(range(1, n + 1)), [False] * n
        text, first, last, changed, at = [], [], [], [], 0
        for start, end, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:start])
            first += self.first[at:start]
            last += self.last[at:start]
            changed += self.changed[at:start]
            if start < end:
                text.append(new)
                first += [self.first[start]] * len(new)
                last += [self.last[end - 1]] * len(new)
                changed += [True] * len(new)
            at = end
        self.text, self.first, self.last, self.changed = "".join(text), first, last, changed


def undo_lookalikes(t: Aligned) -> None:
    if not t.text.isascii() and not _ODD.isdisjoint(set(t.text)):
        t.rewrite([(i, i + 1, LOOKALIKES[ord(c)]) for i, c in enumerate(t.text) if c in _ODD])


def undo_spelling(t: Aligned) -> None:
    """Digit words become digits where another digit or digit word stands next to them or beyond a mark for a dot; "plus" becomes a sign in front of one."""
    found = [(m.start(), m.end(), "+" if m[0].lower() == "plus" else DIGIT_WORDS[m[0].lower()]) for m in _DIGIT_WORD.finditer(t.text)]
    if not found:
        return
    dots = [m.span() for m in _DOT_MARK.finditer(t.text)]
    next_dot, last_dot = dict(dots), {end: start for start, end in dots}
    edits = []
    for i, (start, end, new) in enumerate(found):
        after = _GAP.match(t.text, end).end()
        next_is = after < len(t.text) and "0" <= t.text[after] <= "9" or i + 1 < len(found) and found[i + 1][0] == after
        gap = 0
        while gap < 3 and start - gap > 0 and t.text[start - gap - 1] in _GAP_CHARS:
            gap += 1
        back = start - gap
        last_is = back > 0 and "0" <= t.text[back - 1] <= "9" or i > 0 and found[i - 1][1] == back
        if new != "+" and end in next_dot:
            after = next_dot[end]
            next_is |= "0" <= t.text[after] <= "9" or i + 1 < len(found) and found[i + 1][0] == after
        if new != "+" and start in last_dot:
            back = last_dot[start]
            last_is |= "0" <= t.text[back - 1] <= "9" or i > 0 and found[i - 1][1] == back
        if new == "+":
            edits += [(start, after, new)] if next_is else []
        elif next_is or last_is:
            edits.append((start, end, new))
    if not edits:
        return
    t.rewrite(edits)
    # Commas and line breaks between single digits are no separators of any identifier: read them as spaces.
    t.rewrite([(m.start(), m.end(), " ") for m in re.finditer(r"(?<=[0-9])\s*[,;:\s]\s*(?=[0-9])", t.text) if m[0] != " " and t.changed[m.start() - 1]])
    # Single digits beside a mark for a dot are one number.
    dots = [m.span() for m in _DOT_MARK.finditer(t.text)]
    beside = {start for start, _ in dots} | {end for _, end in dots}
    runs = [m for m in _SPELLED_RUN.finditer(t.text) if (m.start() in beside or m.end() in beside) and all(t.changed[m.start() : m.end() : 2])]
    t.rewrite([(i, i + 1, "") for m in runs for i in range(m.start() + 1, m.end(), 2)])


def undo_marks(t: Aligned) -> None:
    t.rewrite([(m.start(), m.end(), "@") for m in _AT_MARK.finditer(t.text) if _named(t.text, m)])
    if "_" in t.text and _UNDERSCORED.search(t.text):
        found, ends = [], -1
        for m in _UNDERSCORED.finditer(t.text):  # a spelled dot counts only behind an at of the same run
            if m[0].lower() == "_at_":
                ends = re.compile(r"[A-Za-z0-9._-]*").match(t.text, m.end()).end()
            if m.start() < ends:
                found.append((m.start(), m.end(), "@" if m[0].lower() == "_at_" else "."))
        t.rewrite(found)
    t.rewrite([(m.start(), m.end(), ".") for m in _DOT_MARK.finditer(t.text)])


TRANSDUCERS = (undo_lookalikes, undo_spelling, undo_marks)


def find_disguised(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that show only in the rewritten text, in source characters; those that lie in a plain one of their kind are left out."""
    t = Aligned(text)
    for step in TRANSDUCERS:
        step(t)
    if not t.first:  # nothing was rewritten
        return []
    out = []
    for start, kind, end in find(t.text):
        span = (t.first[start], kind, t.last[end - 1])
        if not any(k == kind and s <= span[0] and span[2] <= e for s, k, e in plain):
            out.append(span)
    return out


def write(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


RESULT = "base array<struct<start: int, kind: int, end: int>>, more array<struct<start: int, kind: int, end: int>>, redacted string"


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each identifier replaced by its kind in angle brackets; overlapping spans count as one of the first's kind."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def spans_column():
    """Column function text -> (base spans, more spans, redacted text); null reads as the empty text and is redacted to null."""

    @F.pandas_udf(RESULT)
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        record = lambda found: [{"start": s, "kind": k, "end": e} for s, k, e in found]
        for texts in parts:
            rows = []
            for t in texts:
                base = find(t or "")
                more = find_disguised(t or "", base)
                rows.append((record(base), record(more), None if t is None else redact(t, base + more) if base or more else t))
            yield pd.DataFrame(rows, columns=["base", "more", "redacted"])

    return spans


def digest_column():
    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")
    def digest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for t in texts:
                base = find(t or "")
                more = find_disguised(t or "", base)
                kinds = [k for _, k, _ in base]
                rows.append((*map(kinds.count, range(4)), hashlib.sha256(write(base).encode()).hexdigest(), write(sorted(base + more)), len(more)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised"])

    return digest


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with ``into``: base spans, more spans (start, kind, end in code points) and the redacted text.

    Null and empty texts hold nothing; a null text is redacted to null.  Texts
    are read whole.  Rows are independent: ties, repeated rows and empty tables
    need no rule.  Other columns pass through; a column named ``into`` is replaced.
    """
    return docs.withColumn(into, spans_column()(F.col(text)))


def redact_documents(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and, if there is such a column, ``chars`` set to the new length."""
    out = docs.withColumn(text, spans_column()(F.col(text))["redacted"])
    return out.withColumn(chars, F.length(text).cast(docs.schema[chars].dataType)) if chars in docs.columns else out


def digest_documents(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the plain identifiers, all spans, and the number of disguised ones, of every document."""
    return docs.select("doc_id", digest_column()(F.col("text")).alias("d")).select("doc_id", "d.*")
