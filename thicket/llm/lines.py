"""Counting what the lines of texts are made of, on the bytes of whole Arrow batches.

A token is a run of bytes other than white space, or a letter of a script that is written without
blanks. It is of one kind, told from the classes of its bytes; punctuation at its end is counted
apart. All counts are array operations over the UTF-8 bytes of many texts at once; no text is
looked at in a Python loop.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Classes of bytes.
NL, BLANK, TAB, LOWER, UPPER, DIGIT, STOP, COMMA, COLON, QUOTE, DASH, MARK, PART, SIGN, LETTER, APOS, UNIT = range(17)
#: Kinds of tokens: punctuation alone; a common word, a short and a longer other one; a capitalised common word and another one.
NONE, COMMON, SHORT, LONG, COMMON_UP, NAME, NUMBER, ODD, SIGNS, DASHES, PARTS, DOTS = range(12)
#: Bytes that are counted at a time, cut between texts; a longer token counts as several.
SLICE, TOKEN = 1 << 20, 1 << 20

#: What is known of a line, one integer each.
COUNTS = (
    "common", "short", "long", "names", "number", "odd", "signs", "dashes", "parts", "dots", "tokens", "stops", "commas", "gaps", "three", "begun", "code", "chars", "width",
    "key", "lead", "item", "deep", "stamp", "closed", "small",
)


def _classes() -> np.ndarray:
    c = np.full(256, SIGN, np.uint8)
    for chars, k in ((b"\n", NL), (b" ", BLANK), (b"\t", TAB), (b".!?", STOP), (b",;", COMMA), (b":", COLON), (b'"()[]', QUOTE), (b"-", DASH), (b"*~`+", MARK), (b"|/>=\\&", PART), (b"'", APOS), (b"%$", UNIT)):
        c[list(chars)] = k
    c[ord("a") : ord("z") + 1], c[ord("A") : ord("Z") + 1], c[ord("0") : ord("9") + 1] = LOWER, UPPER, DIGIT
    c[0x80:0xF8] = LETTER
    return c


_CLASS = _classes()
_PUNCT = np.isin(np.arange(17), (STOP, COMMA, COLON, QUOTE))
#: Characters of more than one byte that are no letters, by class.
_WIDE = {
    STOP: "…。！？", COMMA: "、，；", COLON: "：", QUOTE: "“”„«»‘‹›（）「」", DASH: "–—‐‑‒―", MARK: "•‣◦●▪", PART: "→←·│", APOS: "’", UNIT: "°€£", SIGN: "�×÷§¶±¬¤©®™½¼¾¿¡¦¨¯´¸¹²³†‡■□✓✔✗☐☑",
}


def _hash_table() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(11)
    by_byte, by_place = (r.integers(1, 2**62, n, dtype=np.int64) * 2 + 1 for n in (256, 64))
    by_byte[ord("A") : ord("Z") + 1] = by_byte[ord("a") : ord("z") + 1]
    by_byte[[b for b in range(0x80) if not chr(b).isalpha() and chr(b) not in "'-"]] = 0
    return by_byte, by_place


_BY_BYTE, _BY_PLACE = _hash_table()


def word_hashes(words) -> np.ndarray:
    """The sorted hashes of ``words`` in lower case, as tokens have them."""
    out = []
    with np.errstate(over="ignore"):
        for w in words:
            b = np.frombuffer(w.lower().encode(), np.uint8)
            out.append((_BY_BYTE[b] * _BY_PLACE[np.arange(len(b)) & 63]).sum() if len(b) else np.int64(0))
    return np.unique(np.array(out, np.int64))


def _classed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of every byte, and where letters of scripts without blanks begin."""
    c = _CLASS[data]
    apart = np.zeros(len(data), bool)
    wide = np.flatnonzero(data >= 0xC2)
    if not len(wide):
        return c, apart
    b0 = data[wide]
    b1, b2 = data[np.minimum(wide + 1, len(data) - 1)], data[np.minimum(wide + 2, len(data) - 1)]
    latin = b0 == 0xC3  # capitals and small letters of Western languages
    up = latin & (b1 <= 0x9E)
    c[wide[up]] = c[wide[up] + 1] = UPPER
    low = latin & ~up
    c[wide[low]] = c[wide[low] + 1] = LOWER
    pairs = b0 == 0xC2  # signs, but for three letters
    sign = pairs & ~np.isin(b1, (0xAA, 0xB5, 0xBA))
    c[wide[sign]] = c[wide[sign] + 1] = SIGN
    sign = (b0 == 0xE2) | (b0 >= 0xF0)
    for k in range(3):
        c[wide[sign] + k] = SIGN
    c[wide[b0 >= 0xF0] + 3] = SIGN
    code = (b0.astype(np.int32) << 16) | (b1.astype(np.int32) << 8) | np.where(b0 >= 0xE0, b2, 0)
    for k, chars in _WIDE.items():
        for ch in chars:
            e = ch.encode()
            at = wide[code == (e[0] << 16 | e[1] << 8 | (e[2] if len(e) > 2 else 0))]
            for i in range(len(e)):
                c[at + i] = k
    # Thai and Lao, kana, Chinese characters
    alone = ((code >= 0xE0B880) & (code < 0xE0BC80)) | ((code >= 0xE38181) & (code < 0xE38400)) | ((code >= 0xE39080) & (code < 0xEA0000))
    apart[wide[alone]] = True
    return c, apart


def line_counts(data: np.ndarray, known: np.ndarray) -> dict[str, np.ndarray]:
    """``COUNTS`` of every line with a token, with its number ``line`` and the offset ``at`` of its first token.

    ``data`` are the bytes of texts that each end with a line feed.
    """
    c, apart = _classed(data)
    solid = c > TAB
    before = np.concatenate([[False], solid[:-1]])
    first = solid & (~before | apart)
    first[::TOKEN] |= solid[::TOKEN]
    s = np.flatnonzero(first)
    if not len(s):
        return {k: np.zeros(0, np.int64) for k in ("line", "at", *COUNTS)}
    ends = np.flatnonzero(before & ~solid)
    n = len(s)
    index = np.arange(len(data), dtype=np.int32)
    nxt = np.append(s[1:], len(data))
    e = np.minimum(nxt, ends[np.searchsorted(ends, s, side="right")])
    head = (data & 0xC0) != 0x80  # the first byte of a character
    # what a token is made of: three counts of 21 bits in each number
    field = lambda *which: np.isin(np.arange(17), which).astype(np.int64)
    one, two = field(LOWER, UPPER, LETTER) | field(DIGIT) << 21 | field(SIGN) << 42, field(PART) | field(DASH, MARK, APOS) << 21 | field(STOP, COMMA, COLON, QUOTE) << 42
    a, b = np.add.reduceat(one[c], s), np.add.reduceat(two[c], s)
    low = (1 << 21) - 1
    letters, digits, signs, parts, dashes, punct = a & low, a >> 21 & low, a >> 42, b & low, b >> 21 & low, b >> 42
    core = np.maximum.accumulate(np.where(_PUNCT[c] | ~solid, -1, index))  # the last byte that is no punctuation
    last = core[e - 1]
    bare = last < s
    tail = np.where(bare, e - s, e - 1 - last)
    stops_to = np.concatenate([[0], np.cumsum(c == STOP, dtype=np.int32)])
    stop = stops_to[e] > stops_to[np.where(bare, s, last + 1)]
    end = c[e - 1]
    comma, colon = (end == COMMA) & ~stop, (end == COLON) & ~stop
    # a quote or bracket before the word
    wide = np.where(data[s] >= 0xE0, 3, np.where(data[s] >= 0xC2, 2, 1))
    opened = (c[s] == QUOTE) | (c[s] == MARK)
    start = np.minimum(np.where(opened, s + wide, s), len(data) - 1)
    inner = punct - tail - np.where(c[s] == QUOTE, wide, 0)
    word = (letters > 0) & (digits == 0) & (signs == 0) & (parts == 0) & (inner <= 0)
    number = (digits > 0) & (letters == 0) & (signs == 0)
    heads = np.add.reduceat((head & solid).astype(np.int32), s)
    size = heads - np.where(tail > 0, np.minimum(tail, 1), 0) - opened
    capital = c[start] == UPPER
    place = (index - np.maximum.accumulate(np.where(first, index, 0))) & 63
    lower = data.copy()
    big = np.flatnonzero((data == 0xC3)[:-1] & (data[1:] <= 0x9E) & (data[1:] >= 0x80)) + 1
    lower[big] += 0x20
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_BY_BYTE[lower] * _BY_PLACE[place], s)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        common = word & (known[at] == h)
    else:
        common = np.zeros(n, bool)
    only = (letters == 0) & (digits == 0)
    kind = np.full(n, ODD, np.int64)
    kind[number] = NUMBER
    kind[only & ~bare] = SIGNS
    kind[only & ~bare & (parts > 0) & (heads <= 3)] = PARTS
    kind[only & (dashes > 0) & (signs + parts == 0) & (heads <= 3)] = DASHES
    kind[word] = np.where(capital, np.where(common, COMMON_UP, NAME), np.where(common, COMMON, np.where(size <= 3, SHORT, LONG)))[word]
    kind[bare] = NONE
    kind[bare & (stops_to[e] - stops_to[s] >= 4)] = DOTS
    # lines
    breaks = np.flatnonzero(c == NL)
    number_of = np.searchsorted(breaks, s)
    new = np.ones(n, bool)
    new[1:] = number_of[1:] != number_of[:-1]
    of = np.cumsum(new) - 1
    f = np.flatnonzero(new)
    k = len(f)
    z = np.append(f[1:], n) - 1
    line = number_of[f]
    from_ = np.where(line > 0, breaks[np.maximum(line - 1, 0)] + 1, 0)
    kinds = np.bincount(of * 12 + kind, minlength=12 * k).reshape(k, 12)
    marks = np.bincount(of * 4 + np.where(stop, 1, np.where(comma, 2, np.where(colon, 3, 0))), minlength=4 * k).reshape(k, 4)
    per = lambda mask: np.bincount(of[mask], minlength=k)
    tabs = np.concatenate([[0], np.cumsum(c == TAB, dtype=np.int32)])
    gap = np.zeros(n, bool)
    gap[1:] = ~new[1:] & ((s[1:] - e[:-1] >= 3) | (tabs[s[1:]] > tabs[e[:-1]]))
    f3 = common.copy()
    f3[:-2] &= common[1:-1] & common[2:] & (of[2:] == of[:-2])
    f3[-2:] = False
    # a sentence begins after a stop, or with the paragraph
    begins = np.ones(n, bool)
    begins[1:] = stop[:-1] | (number_of[1:] - number_of[:-1] > 1)
    begins &= (kind == COMMON_UP) | (kind == NAME)
    key = np.full(k, 99, np.int64)
    at = np.flatnonzero(colon)[::-1]
    key[of[at]] = at - f[of[at]] + 1
    count = lambda mask: np.add.reduceat(mask.astype(np.int32), from_)
    brackets = (c == PART) | (c == SIGN) | np.isin(data, np.frombuffer(b"()[];+*$", np.uint8))
    chars_to = np.concatenate([[0], np.cumsum(head, dtype=np.int32)])
    closer = (data[e - 1] == ord(".")) | (data[e - 1] == ord(")"))
    item = closer[f] & ((digits[f] > 0) & (digits[f] <= 4) & (letters[f] == 0) & (dashes[f] == 0) & (inner[f] <= 0) | (letters[f] == 1) & (digits[f] == 0)) & (kind[f] != NONE)
    box = (data[s[f]] == ord("[")) & ((data[e[f] - 1] == ord("]")) & (heads[f] <= 3) | (e[f] - s[f] == 1))
    stamp = (c[np.where(data[s[f]] == ord("["), np.minimum(s[f] + 1, len(data) - 1), s[f])] == DIGIT) & (digits[f] >= 3) & (dashes[f] + parts[f] + np.maximum(inner[f], 0) > 0)
    return {
        "line": line, "at": s[f], "common": kinds[:, COMMON] + kinds[:, COMMON_UP], "short": kinds[:, SHORT], "long": kinds[:, LONG], "names": kinds[:, NAME], "number": kinds[:, NUMBER],
        "odd": kinds[:, ODD], "signs": kinds[:, SIGNS], "dashes": kinds[:, DASHES], "parts": kinds[:, PARTS], "dots": kinds[:, DOTS], "tokens": z - f + 1 - kinds[:, NONE], "stops": marks[:, 1], "commas": marks[:, 2],
        "gaps": per(gap), "three": per(f3), "begun": per(begins), "code": count(brackets), "chars": count(head & solid), "width": chars_to[e[z]] - chars_to[s[f]], "key": key,
        "lead": np.isin(kind[f], (DASHES, SIGNS, PARTS)), "item": item | box, "deep": (s[f] - from_ >= 3) | (tabs[s[f]] > tabs[from_]), "stamp": stamp,
        "closed": stop[z], "small": np.isin(kind[f], (COMMON, SHORT, LONG)),
    }


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray, known: np.ndarray) -> dict[str, np.ndarray]:
    """``line_counts`` of bytes of any number, cut at line ends, after a blank line where there is one."""
    if len(data) <= 2 * SLICE:
        return line_counts(data, known)
    out, at, lines = [], 0, 0
    breaks = np.flatnonzero(data == 10)
    blank = breaks[1:][np.diff(breaks) == 1]
    while at < len(data):
        to = len(data)
        if to - at > SLICE:
            for places in (blank, breaks):
                i = int(np.searchsorted(places, at + SLICE, side="right")) - 1
                if i >= 0 and places[i] >= at:
                    to = int(places[i]) + 1
                    break
            else:
                to = int(breaks[np.searchsorted(breaks, at)]) + 1
        part = line_counts(data[at:to], known)
        out.append(part | {"line": part["line"] + lines, "at": part["at"] + at})
        lines += int((data[at:to] == 10).sum())
        at = to
    return {k: np.concatenate([x[k] for x in out]) for k in out[0]}


def count_batches(known: np.ndarray, keep: list[str]):
    """For ``mapInArrow``: rows of ``keep`` and ``text`` -> doc, block, ``COUNTS`` and ``keep`` of every line.

    ``doc`` numbers the rows of a partition, ``block`` the paragraphs between blank lines. ``keep`` is given with the
    first line of a text only. A text without a line has one row of zeros.
    """

    def run(batches):
        docs = 0
        for batch in batches:
            data, offsets = _texts(batch.column(batch.schema.get_field_index("text")))
            lo = 0
            while lo < len(offsets) - 1:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, side="right")) - 1)
                got = _pieces(data[offsets[lo] : offsets[hi]], known)
                doc = np.searchsorted(offsets[lo : hi + 1] - offsets[lo], got["at"], side="right") - 1
                missing = np.setdiff1d(np.arange(hi - lo), doc)
                doc = np.concatenate([doc, missing])
                order = np.argsort(doc, kind="stable")
                pad = lambda x: np.concatenate([np.asarray(x).astype(np.int32), np.zeros(len(missing), np.int32)])[order]  # noqa: B023, E731
                doc, line = doc[order], pad(got["line"])
                new = np.ones(len(doc), bool)
                new[1:] = doc[1:] != doc[:-1]
                block = np.ones(len(doc), bool)
                block[1:] = new[1:] | (line[1:] - line[:-1] > 1)
                rows = pa.array(doc + lo, mask=~new)
                columns = [pa.array(doc + docs + lo), pa.array(np.cumsum(block).astype(np.int32)), *(pa.array(pad(got[n])) for n in COUNTS)]
                columns += [batch.column(batch.schema.get_field_index(n)).take(rows) for n in keep]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "block", *COUNTS, *keep])
                lo = hi
            docs += len(offsets) - 1

    return run


def _whole_docs(batches):
    """The rows of ``batches`` in tables that no document spans."""
    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        doc = b.column(b.schema.get_field_index("doc")).to_numpy()
        at = int(np.searchsorted(doc, doc[-1]))
        if at or (held and held[-1].column(0)[0].as_py() != doc[0]):
            yield pa.Table.from_batches([*held, b.slice(0, at)]).combine_chunks()
            held = []
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


#: Sums over the lines of a paragraph.
SUMS = ("common", "short", "long", "names", "number", "odd", "signs", "stops", "commas", "three", "begun", "closed", "small", "chars", "width")


def sum_paragraphs(keep: list[str]):
    """For ``mapInArrow``: lines with ``structure`` -> doc, lines, longest, ``SUMS`` and ``keep`` of each paragraph.

    A line of several ends of sentence is a paragraph of its own; of the other lines of a block those that are one whole
    sentence belong together, and so do the rest.
    """

    def run(batches):
        for t in _whole_docs(batches):
            c = {n: t.column(n).to_numpy() for n in ("doc", "block", "structure", "stops", "closed", "small")}
            n = len(c["doc"])
            gone = c["structure"].astype(bool)
            new = np.ones(n, bool)
            new[1:] = (c["doc"][1:] != c["doc"][:-1]) | (c["block"][1:] != c["block"][:-1])
            unit = (np.cumsum(new) - 1) * 3 + np.where((c["stops"] == 1) & (c["closed"] == 1) & (c["small"] == 0), 1, 0)
            unit = np.where(c["stops"] >= 2, np.arange(n) + 3 * n, unit)
            unit[gone] = (c["doc"] - c["doc"][0])[gone] + 5 * n
            _, at, of = np.unique(unit, return_index=True, return_inverse=True)
            k = len(at)
            live = ~gone
            order = np.argsort(at, kind="stable")
            total = lambda x: np.bincount(of, np.where(live, x, 0), k)[order].astype(np.int64)  # noqa: B023, E731
            longest = np.zeros(k, np.int64)
            np.maximum.at(longest, of, np.where(live, t.column("width").to_numpy(), 0))
            doc = c["doc"][at[order]]
            first = np.ones(k, bool)
            first[1:] = doc[1:] != doc[:-1]
            rows = pa.array(np.where(first, np.searchsorted(c["doc"], doc), 0), mask=~first)
            columns = [pa.array(doc), pa.array(total(np.ones(n))), pa.array(longest[order]), *(pa.array(total(t.column(s).to_numpy())) for s in SUMS)]
            columns += [t.column(s).take(rows).combine_chunks() for s in keep]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "lines", "longest", *SUMS, *keep])

    return run


def sum_documents(keep: list[str]):
    """For ``mapInArrow``: paragraphs with ``prose`` (characters) -> ``prose`` and ``keep`` of each text."""

    def run(batches):
        for t in _whole_docs(batches):
            doc = t.column("doc").to_numpy()
            at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            prose = np.add.reduceat(t.column("prose").to_numpy(), at)
            columns = [pa.array(prose), *(t.column(s).take(pa.array(at)).combine_chunks() for s in keep)]
            yield pa.RecordBatch.from_arrays(columns, names=["prose", *keep])

    return run
