"""Personal data, found in the text as it stands and under disguises.

Plain identifiers are matched directly. Transducers then rewrite the text, each keeping for every output character
the source characters it came from: the first maps look-alike letters, wide forms and foreign digits to ASCII and drops
invisible characters; the second rewrites at/dot disguises (in brackets, bare, between marks) and spelled digits.
Identifiers found in the rewritten text are mapped back to source spans and added where they rest on a rewrite and touch
no plain one of their kind but as the whole of which it is a part. A bare "at" before a plain domain is ambiguous ("the docs at site.org"): it makes an address
only where the local part isn't a mere word, the domain is a mail service's, or a word such as "mail" announces one.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like ASCII letters, and the ASCII letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l", "һ": "h", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ɩ": "i", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-",
}
INVISIBLE = "­​‌‍⁠﻿"
# Words for the digits 0 to 9 in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that starts inside a run of digits would have started before it, so only run starts are tried: linear time.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DOTTED = re.compile(r"[0-9]\.[0-9]+\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# English numbers of two digits, what doubles a digit, and words for marks between digits.
TENS = {"ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90"}
REPEATS = {"double": 2, "doble": 2, "triple": 3, "treble": 3}
MARKS = {"dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-", "plus": "+"}
# Words for @ and the dot; domains of mail services; words that announce an address; words that stand before
# a plain "at".
AT_WORDS, DOT_WORDS = "at|ät|arobase|arroba", "dot|punkt|point|punto"
MAIL_DOMAINS = frozenset("gmail googlemail yahoo hotmail outlook live icloud aol gmx web proton protonmail fastmail yandex mail".split())
TOP_DOMAINS = frozenset("com org net edu gov info biz".split())
ANNOUNCES = re.compile(r"mail|contact|write|reach|address|adresse|courriel|correo|kontakt|escrib", re.I)
PLAIN_LOCALS = frozenset("me us you it him her them look looked see meet is are be was were here there not and or online available found hosted live read visit more only now".split())
ARTICLES = frozenset("the a an this that my our your his her their its least most all any some".split())
#: Characters before a bare "at" that are looked at for an announcement, and the longest local part of a disguised address.
_NEAR, _LOCAL = 40, 64

_SPELLED = frozenset(DIGIT_WORDS) | frozenset(TENS)
_NUMBER_WORDS = _SPELLED | frozenset(MARKS) | frozenset(REPEATS)
_TOKEN = re.compile(rf"(?<![^\W_])(?:({'|'.join(sorted(_NUMBER_WORDS, key=len, reverse=True))})|([0-9]+))(?![^\W_])", re.I)
_GAP = re.compile(r"[ .,()\n-]{0,3}")
_BRACKETED = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:({AT_WORDS}|@)|{DOT_WORDS}|\.)\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
_BARE_AT = re.compile(rf"(?:\s{{1,3}}@\s{{1,3}}|@|(?:(?P<mark>[_-])|\s{{1,3}})(?P<word>{AT_WORDS})(?(mark)(?P=mark)|\s{{1,3}}))(?=[A-Za-z0-9])", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
_PLAIN_LABEL = re.compile(r"[A-Za-z0-9]{1,63}")
_BARE_DOT = re.compile(rf"\.|\s{{1,3}}(?P<word>{DOT_WORDS})\s{{1,3}}|\s\.\s", re.I)
_MARKED_DOT = {m: re.compile(rf"{m}(?P<word>{DOT_WORDS}){m}", re.I) for m in "_-"}


def _folded() -> dict[int, str]:
    """What looks like ASCII: by compatibility (wide, mathematical, circled, raised forms), small capitals, digits of all
    scripts, and the letters listed."""
    table: dict[int, str] = {}
    for c in range(0x80, 0x20000):
        like = unicodedata.normalize("NFKC", chr(c))
        if like.isascii() and like.isprintable() and like.strip() == like and like:
            table[c] = like
        elif unicodedata.category(chr(c)) == "Nd":
            table[c] = str(unicodedata.decimal(chr(c)))
        elif m := re.fullmatch(r"LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(chr(c), "")):
            table[c] = m[1].lower()
    return table | {ord(k): v for k, v in LOOKALIKES.items()} | dict.fromkeys(map(ord, INVISIBLE), "")


FOLDED = _folded()
_FOLDABLE = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(FOLDED)) + "]")
_FOLDS = frozenset(map(chr, FOLDED))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outward: its local part is the run of fitting characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _TAIL.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind as listed."""
    found = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text) if _DOTTED.search(text) else ():
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


class Rewritten:
    """A text after rewrites; source(a, b) is the source span of its characters a to b, changed(a, b) if a rewrite fell there."""

    def __init__(self, text: str):
        self.text, self._from, self._to, self._new = text, None, None, []

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces spans (start, end, by), which are in order and apart."""
        if not edits:
            return
        n = len(self.text)
        begin, end = self._from or list(range(n)), self._to or list(range(1, n + 1))
        out, start, stop, new, at, made = [], [], [], [], 0, 0
        old, k = self._new, 0
        for a, b, by in [*edits, (n, n, None)]:
            while k < len(old) and old[k] < b:
                if at <= old[k] < a:
                    new.append(made + old[k] - at)
                k += 1
            out.append(self.text[at:a])
            start += begin[at:a]
            stop += end[at:a]
            made += a - at
            if by is not None:
                out.append(by)
                start += [begin[a]] * len(by)
                stop += [end[b - 1]] * len(by)
                new += range(made, made + len(by)) if by else [made]
                made += len(by)
            at = b
        self.text, self._from, self._to, self._new = "".join(out), start, stop, new

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (self._from[a], self._to[b - 1]) if self._from else (a, b)

    def changed(self, a: int, b: int) -> bool:
        k = bisect_left(self._new, a)
        return k < len(self._new) and self._new[k] < b


def rewrite(text: str) -> Rewritten | None:
    """All transducers in turn; None if none has anything to do."""
    out = Rewritten(text)
    if not text.isascii() and not _FOLDS.isdisjoint(text):
        out.apply([(m.start(), m.end(), FOLDED[ord(m[0])]) for m in _FOLDABLE.finditer(text)])
    out.apply([(*m.span(), "@" if m[1] else ".") for m in _BRACKETED.finditer(out.text)])
    out.apply(_apart(_addresses(out)))
    if _spells(out.text.lower()):
        out.apply(_digits(out.text))
    return out if out.text is not text else None


def _domain(text: str, at: int, mark: str | None) -> tuple[list[tuple[int, int]], int] | None:
    """The separators of a domain that starts at ``at``, and its end: labels between dots or words for them, one word throughout."""
    labels, dots = (_PLAIN_LABEL, _MARKED_DOT[mark]) if mark else (_LABEL, _BARE_DOT)
    seps: list[tuple[int, int]] = []
    label, word, end = labels.match(text, at), None, at
    while label and len(seps) < 8:
        end = label.end()
        sep = dots.match(text, end)
        following = sep and labels.match(text, sep.end())
        own = sep and (sep["word"] or "").lower()
        if not following or (own and word and own != word):
            break
        # After a domain's usual end only a country can follow, unless the dots are plain.
        if seps and label[0].lower() in TOP_DOMAINS and sep[0] != "." and len(following[0]) != 2:
            break
        word = own or word
        seps.append(sep.span())
        label = following
    if not seps or not text[seps[-1][1] : end].strip("-").isalpha() or end - seps[-1][1] < 2:
        return None
    return seps, end


def _addresses(out: Rewritten) -> list[tuple[int, int, str]]:
    """Edits that write words for @ and the dot as such, where an address stands around them."""
    text, edits, done = out.text, [], 0
    for m in _BARE_AT.finditer(text):
        start = m.start()
        least = max(done, start - _LOCAL)
        # Where the at is set off by marks, they end the local part.
        while start > least and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        local = text[start : m.start()]
        found = _domain(text, m.end(), m["mark"]) if local.strip("._%+-") else None
        if not found:
            continue
        seps, end = found
        spoken = [s for s in seps if text[slice(*s)] != "."]
        if m["word"]:
            name = text[m.end() : seps[0][0]].lower()
            if local.lower() in PLAIN_LOCALS or name in ARTICLES or name in ("dot", "point"):
                continue
            # A spoken or rewritten dot gives an address away; a plain domain needs another sign.
            sure = spoken or any(out.changed(*s) for s in seps) or not local.isalpha() or name in MAIL_DOMAINS or ANNOUNCES.search(text, max(0, start - _NEAR), start)
            if not sure:
                continue
        elif m[0] == "@" and not spoken:
            continue
        if m[0] != "@":
            edits.append((*m.span(), "@"))
        edits += [(*s, ".") for s in spoken]
        done = end
    return edits


def _digits(text: str) -> list[tuple[int, int, str]]:
    """Edits that write runs of spelled digits, numbers and marks as figures."""
    edits: list[tuple[int, int, str]] = []
    run: list[re.Match] = []

    def close() -> None:
        while run and run[-1][1] and run[-1][1].lower() not in _SPELLED:
            run.pop()
        if sum(bool(t[2]) or t[1].lower() in _SPELLED for t in run) < 3 or not any(t[1] and t[1].lower() in _SPELLED for t in run):
            return
        times, tens = 1, False
        for t, following in zip(run, [*run[1:], None]):
            word = (t[1] or "").lower()
            gap = text[t.end() : following.start()] if following else ""
            joint = "." if "." in gap and not (following and following[1] and following[1].lower() in MARKS) and word not in MARKS else ""
            if word in REPEATS:
                times, by = REPEATS[word], ""
            elif word in MARKS:
                by = MARKS[word]
            else:
                by = t[2] or DIGIT_WORDS.get(word) or TENS[word]
                # "ninety two" is 92.
                if word in TENS and by[1] == "0" and by != "10" and following and DIGIT_WORDS.get((following[1] or "").lower(), "0") != "0" and "." not in gap:
                    by = by[0]
                by, times = by * times, 1
            edits.append((t.start(), t.end() + len(gap), by + joint))

    for t in _TOKEN.finditer(text):
        if run:
            gap = _GAP.match(text, run[-1].end())
            if gap.end() < t.start() or (run[-1][2] and t[2]) and "." not in gap[0] and " " not in gap[0] and "-" not in gap[0]:
                close()
                run = []
        if run or not t[1] or t[1].lower() in _SPELLED or t[1].lower() in REPEATS or t[1].lower() == "plus":
            run.append(t)
    close()
    return edits


def _spells(lower: str) -> bool:
    """Whether the lower-cased text has a spelled digit beside another, a figure, or a word for a mark or a repeat."""
    words = lower.replace("-", " ").replace(".", " ").replace(",", " ").replace("(", " ").replace(")", " ").split()
    if _SPELLED.isdisjoint(words):
        return False
    return any((w in _SPELLED and (v in _NUMBER_WORDS or v.isdigit())) or (v in _SPELLED and (w in _NUMBER_WORDS or w.isdigit())) for w, v in zip(words, words[1:]))


def _apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    kept: list[tuple[int, int, str]] = []
    for x in sorted(edits):
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The plain spans, and those that only the rewritten text shows, as source spans."""
    base = plain_spans(text)
    out = rewrite(text)
    added: list[tuple[str, int, int]] = []
    if out:
        taken = {k: sorted((a, b) for x, a, b in base if x == k) for k in KINDS}
        for kind, a, b in plain_spans(out.text):
            if out.changed(a, b):
                s, e = out.source(a, b)
                own, k = taken[kind], bisect_left(taken[kind], (s, s))
                met = ([own[k - 1]] if k and own[k - 1][1] > s else []) + ([own[k]] if k < len(own) and own[k][0] < e else [])
                # A plain one that is but a part of it was cut short by the disguise.
                if all(s <= p and q <= e and (s, e) != (p, q) for p, q in met):
                    added.append((kind, s, e))
    return base, added


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def find(docs: DataFrame) -> DataFrame:
    """Of (doc_id, text): doc_id, the numbers of plain spans n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    One row per input row, repeated rows included. Null text is empty: no spans, the digest of nothing. A null doc_id is
    kept. Texts are read whole, in linear time; other columns are ignored. An empty table gives no rows. base_sha256 is of
    the plain spans alone, ``spans`` lists plain and added ones; n_added counts those that disguises hid.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, listed, more = [], [], []
            for text in batch.column(1):
                base, added = all_spans(text.as_py() or "")
                for k in KINDS:
                    counts[k].append(sum(x[0] == k for x in base))
                digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                listed.append(_listed(base + added))
                more.append(len(added))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(listed, pa.string()), pa.array(more, pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")
