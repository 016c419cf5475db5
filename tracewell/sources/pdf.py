"""Pages, blocks of text with boxes, links, images and outlines of PDF files, without a library.

Objects are found by their headers and in object streams, so a file with a damaged table
of objects is read too; of an object given twice the later one counts.  Streams are plain
or deflated, with or without PNG predictors.  Text is what the content streams show, by
the fonts' maps to Unicode, else as Latin text; lines whose baselines lie within one and a
half of their height are one block.  Boxes are in points from the upper left corner.

Not read: encrypted files (an error), other stream filters, text inside images, vertical
writing, and forms drawn inside pages.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "path string, kind string, page int, ord int, label string, text string, target_text string, target_page int, box struct<x0:double,y0:double,x1:double,y1:double>, height double, error string"

_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]{}(]|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]*|[^\s()<>\[\]{}/%]+", re.S)
_HEADER = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Name(str):
    """A name object."""


class Operator(bytes):
    """A word that is no object, such as an operator of a content stream."""


@dataclass(frozen=True)
class Ref:
    """A reference to another object."""

    number: int


@dataclass
class Stream:
    """A dictionary with the bytes behind it, as they stand in the file."""

    head: dict
    raw: bytes


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][:1] in b"\r\n" else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses from ``at`` on, which may hold others, and where it ends."""
    depth, i = 0, at
    while i < len(data):
        c = data[i]
        if c == 92:
            i += 1
        elif c == 40:
            depth += 1
        elif c == 41:
            depth -= 1
            if not depth:
                break
        i += 1
    return data[at : i + 1], i + 1


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[bytes, int]]:
    """The tokens of ``data`` and where each ends. A string in parentheses may hold others, so its end is looked for."""
    while found := _TOKEN.search(data, at):
        token, at = found[0], found.end()
        if token == b"(":
            token, at = _literal(data, found.start())
        if token[:1] != b"%":
            yield token, at


def parse(stream: Iterator[tuple[bytes, int]]) -> Iterator[tuple[object, int]]:
    """Objects (dictionaries, lists, names, numbers, strings as bytes, references) and operators."""
    stack: list[tuple[bytes, list]] = []
    done: list = []

    def close(items: list) -> dict:
        return {str(k): v for k, v in zip(items[::2], items[1::2])}

    for token, end in stream:
        if token in (b"<<", b"["):
            stack.append((token, done))
            done = []
            continue
        if token in (b">>", b"]") and stack:
            opened, outer = stack.pop()
            value: object = close(done) if opened == b"<<" else done
            done = outer
        elif token[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), token[1:]).decode("latin-1"))
        elif token[:1] in (b"(", b"<"):
            value = _string(token)
        elif token == b"R" and len(done) >= 2 and stack:
            done.pop()
            value = Ref(int(done.pop()))
        else:
            try:
                value = int(token) if re.fullmatch(rb"[+-]?\d+", token) else float(token)
            except ValueError:
                value = {b"true": True, b"false": False, b"null": None}.get(token, Operator(token))
        if stack:
            done.append(value)
        else:
            yield value, end


def _undo(data: bytes, parms: dict) -> bytes:
    """What PNG predictors were applied to."""
    width = int(parms.get("Columns", 1)) * int(parms.get("Colors", 1)) * int(parms.get("BitsPerComponent", 8)) + 7 >> 3
    step, out, above = max(1, int(parms.get("Colors", 1)) * int(parms.get("BitsPerComponent", 8)) >> 3), bytearray(), bytearray(width)
    for at in range(0, len(data), width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width].ljust(width, b"\0"))
        for i in range(width):
            left, up, corner = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            near = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
            row[i] = (row[i] + (0, left, up, (left + up) // 2, near)[kind if kind < 5 else 0]) & 255
        out += row
        above = row
    return bytes(out)


@dataclass
class File:
    """The objects of a file."""

    objects: dict[int, object] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)

    def get(self, value: object) -> object:
        """The object behind a reference, however many lead to it."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.number)
        return None

    def of(self, value: object, key: str, kind: type = dict) -> object:
        """An entry of a dictionary, empty if it is missing or of another kind."""
        holder = self.get(value)
        holder = holder.head if isinstance(holder, Stream) else holder
        found = self.get(holder.get(key)) if isinstance(holder, dict) else None
        return found if isinstance(found, kind) else kind()

    def body(self, stream: Stream) -> bytes:
        """The decoded bytes of a stream."""
        data, filters, parms = stream.raw, self.get(stream.head.get("Filter")), self.get(stream.head.get("DecodeParms"))
        filters = [] if filters is None else filters if isinstance(filters, list) else [filters]
        parms = parms if isinstance(parms, list) else [parms]
        for k, name in enumerate(filters):
            if self.get(name) != "FlateDecode":
                raise ValueError(f"filter {name}")
            data = zlib.decompressobj().decompress(data)
            given = self.get(parms[k]) if k < len(parms) else None
            if isinstance(given, dict) and int(given.get("Predictor", 1)) > 1:
                data = _undo(data, given)
        return data


def load(data: bytes) -> File:
    """All objects of a file."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise ValueError("no PDF file")
    out = File()
    at = 0
    while found := _HEADER.search(data, at):
        at = found.end()
        value, at = next(parse(tokens(data, at)), (None, at))
        if isinstance(value, dict) and (begin := re.compile(rb"\s*stream(?:\r\n|\n|\r)").match(data, at)):
            size = value.get("Length")
            end = begin.end() + size if isinstance(size, int) and data[begin.end() + size :][:16].lstrip().startswith(b"endstream") else data.find(b"endstream", begin.end())
            end = len(data) if end < 0 else end
            value, at = Stream(value, data[begin.end() : end]), end
            if value.head.get("Type") == "XRef":
                out.trailer |= value.head
        out.objects[int(found[1])] = value
    for found in re.finditer(rb"trailer\b", data):
        value, _ = next(parse(tokens(data, found.end())), ({}, 0))
        out.trailer |= value if isinstance(value, dict) else {}
    if "Encrypt" in out.trailer:
        raise ValueError("the file is encrypted")
    for holder in [o for o in out.objects.values() if isinstance(o, Stream) and o.head.get("Type") == "ObjStm"]:
        body, first, n = out.body(holder), int(out.get(holder.head["First"])), int(out.get(holder.head["N"]))
        head = [int(x) for x in body[:first].split()[: 2 * n]]
        for number, start in zip(head[::2], head[1::2]):
            if number not in out.objects:
                out.objects[number] = next(parse(tokens(body, first + start)), (None, 0))[0]
    return out


def _pages(pdf: File) -> list[tuple[int, dict]]:
    """Object number and dictionary of each page in order, with what it inherits."""
    found, todo, seen = [], [(pdf.of(pdf.trailer, "Root").get("Pages"), {})], set()
    while todo:
        ref, given = todo.pop()
        node = pdf.get(ref)
        if not isinstance(node, dict) or (isinstance(ref, Ref) and ref.number in seen):
            continue
        if isinstance(ref, Ref):
            seen.add(ref.number)
        node = given | node
        if isinstance(kids := pdf.get(node.get("Kids")), list):
            todo += [(kid, {k: node[k] for k in ("MediaBox", "Resources", "Rotate") if k in node}) for kid in reversed(kids)]
        else:
            found.append((ref.number if isinstance(ref, Ref) else -1, node))
    return found


def _label(pdf: File, n: int) -> list[str | None]:
    """The label of each of ``n`` pages."""
    rules, todo = [], [pdf.of(pdf.trailer, "Root").get("PageLabels")]
    while todo:
        node = pdf.get(todo.pop())
        if isinstance(node, dict):
            todo += pdf.of(node, "Kids", list)
            nums = pdf.of(node, "Nums", list)
            rules += [(int(pdf.get(k)), pdf.get(v)) for k, v in zip(nums[::2], nums[1::2])]
    out: list[str | None] = [None] * n
    rules.sort(key=lambda r: r[0])
    for (start, rule), following in zip(rules, [*[r[0] for r in rules[1:]], n]):
        for page in range(max(0, start), min(n, following)):
            number, style = int(rule.get("St", 1)) + page - start, rule.get("S")
            out[page] = _text(rule.get("P", b"")) + {"D": str, "R": lambda k: _roman(k).upper(), "r": _roman, "A": lambda k: _letters(k).upper(), "a": _letters}.get(style, lambda k: "")(number)
    return out


def _roman(number: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (number // value)
        number %= value
    return out


def _letters(number: int) -> str:
    return chr(97 + (number - 1) % 26) * ((number - 1) // 26 + 1)


def _text(raw: object) -> str:
    """A text string."""
    if not isinstance(raw, bytes):
        return ""
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


@dataclass
class Font:
    """How the bytes of a font become text, and how wide they are in thousandths."""

    names: dict[int, str]
    widths: dict[int, float]
    size: int

    def read(self, raw: bytes) -> tuple[str, float]:
        codes = [int.from_bytes(raw[i : i + self.size], "big") for i in range(0, len(raw), self.size)]
        text = "".join(self.names.get(c, bytes([c]).decode("cp1252", "replace") if self.size == 1 else "\ufffd") for c in codes)
        return text, sum(self.widths.get(c, self.widths.get(-1, 500.0)) for c in codes)


def _font(pdf: File, value: object) -> Font:
    names: dict[int, str] = {}
    if isinstance(held := pdf.get((pdf.get(value) or {}).get("ToUnicode")), Stream):
        body = pdf.body(held)

        def sign(raw: bytes) -> str:
            return raw.decode("utf-16-be", "replace")

        for part in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
            codes = [_string(t) for t in re.findall(rb"<[^>]*>", part)]
            names |= {int.from_bytes(a, "big"): sign(b) for a, b in zip(codes[::2], codes[1::2])}
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
            for low, high, to in re.findall(rb"<([^>]*)>\s*<([^>]*)>\s*(<[^>]*>|\[[^\]]*\])", part):
                first, last = int(low, 16), int(high, 16)
                listed = [_string(t) for t in re.findall(rb"<[^>]*>", to)]
                for k in range(min(last - first, 65535) + 1):
                    if to[:1] == b"[":
                        names |= {first + k: sign(listed[k])} if k < len(listed) else {}
                    else:
                        names[first + k] = sign(listed[0][:-2] + (int.from_bytes(listed[0][-2:], "big") + k & 0xFFFF).to_bytes(2, "big"))
    wide = (pdf.get(value) or {}).get("Subtype") == "Type0"
    start, widths = pdf.of(value, "FirstChar", int), pdf.of(value, "Widths", list)
    return Font(names, {start + k: float(pdf.get(w) or 0) for k, w in enumerate(widths)}, 2 if wide else 1)


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def _shown(pdf: File, page: dict) -> tuple[list[tuple], list[tuple]]:
    """Runs of text (x0, y0, x1, y1, text; y upwards) in the order they are shown, and the boxes of images."""
    resources = pdf.get(page.get("Resources")) or {}
    fonts, drawn = {k: _font(pdf, v) for k, v in pdf.of(resources, "Font").items()}, pdf.of(resources, "XObject")
    contents = pdf.get(page.get("Contents"))
    parts = [pdf.get(c) for c in (contents if isinstance(contents, list) else [contents])]
    data = b"\n".join(pdf.body(p) for p in parts if isinstance(p, Stream))
    # Images within the stream hold bytes that are no operators.
    data = re.sub(rb"\bBI\b.*?\bID\s.*?\sEI\b", b" ", data, flags=re.S)
    runs, images, kept, saved = [], [], [], []
    state, matrix, line = _IDENTITY, _IDENTITY, _IDENTITY
    font, size, leading, gap = Font({}, {}, 1), 12.0, 0.0, 0.0

    def show(raw: bytes) -> None:
        nonlocal matrix
        text, width = font.read(raw)
        advance = width / 1000 * size + gap * len(text)
        whole = _times(matrix, state)
        corners = [(x * whole[0] + y * whole[2] + whole[4], x * whole[1] + y * whole[3] + whole[5]) for x, y in ((0, -0.2 * size), (advance, 0.8 * size))]
        (xa, ya), (xb, yb) = corners
        if text:
            runs.append((min(xa, xb), min(ya, yb), max(xa, xb), max(ya, yb), text))
        matrix = _times((1, 0, 0, 1, advance, 0), matrix)

    def moved(x: float, y: float) -> None:
        nonlocal matrix, line
        line = matrix = _times((1, 0, 0, 1, x, y), line)

    for value, _ in parse(tokens(data)):
        if not isinstance(value, Operator):
            kept.append(value)
            continue
        op, given = bytes(value), kept
        numbers = [float(x) for x in given if isinstance(x, (int, float))]
        if op == b"q":
            saved.append(state)
        elif op == b"Q" and saved:
            state = saved.pop()
        elif op == b"cm" and len(numbers) == 6:
            state = _times(tuple(numbers), state)
        elif op == b"BT":
            matrix = line = _IDENTITY
        elif op == b"Tf" and given:
            font, size = fonts.get(str(given[0]), font), numbers[-1] if numbers else size
        elif op == b"Tc" and numbers:
            gap = numbers[0]
        elif op == b"TL" and numbers:
            leading = numbers[0]
        elif op in (b"Td", b"TD") and len(numbers) == 2:
            leading = -numbers[1] if op == b"TD" else leading
            moved(*numbers)
        elif op == b"Tm" and len(numbers) == 6:
            line = matrix = tuple(numbers)
        elif op == b"T*":
            moved(0, -leading)
        elif op == b"Do" and given and isinstance(thing := pdf.get(drawn.get(str(given[0]))), Stream) and thing.head.get("Subtype") == "Image":
            xs, ys = ([a * state[k] + b * state[k + 2] + state[k + 4] for a, b in ((0, 0), (1, 0), (0, 1), (1, 1))] for k in (0, 1))
            images.append((min(xs), min(ys), max(xs), max(ys)))
        kept = []
        for piece in given if op in (b"Tj", b"'", b'"') else (given[0] if op == b"TJ" and given and isinstance(given[0], list) else ()):
            if isinstance(piece, bytes):
                if op in (b"'", b'"'):
                    moved(0, -leading)
                show(piece)
            elif op == b"TJ" and isinstance(piece, (int, float)):
                matrix = _times((1, 0, 0, 1, -piece / 1000 * size, 0), matrix)
                if piece < -200 and runs:
                    runs[-1] = (*runs[-1][:4], runs[-1][4] + " ")
    return runs, images


def _blocks(runs: list[tuple]) -> list[tuple]:
    """Blocks (x0, y0, x1, y1, text) of runs: those on one baseline are a line, near lines a block."""
    lines: list[list] = []
    for x0, y0, x1, y1, text in runs:
        last = lines[-1] if lines else None
        if last and abs(last[1] - y0) < 0.3 * (y1 - y0) and x0 >= last[2] - 0.3 * (y1 - y0):
            last[4] += (" " if x0 - last[2] > 0.2 * (y1 - y0) and not last[4].endswith(" ") else "") + text
            last[1], last[2], last[3] = min(last[1], y0), max(last[2], x1), max(last[3], y1)
        else:
            lines.append([x0, y0, x1, y1, text])
    blocks: list[list] = []
    for line in lines:
        last, high = blocks[-1] if blocks else None, line[3] - line[1]
        if last and 0 <= last[5] - line[1] <= 1.5 * high and line[0] < last[2] and last[0] < line[2]:
            last[:5] = [min(last[0], line[0]), min(last[1], line[1]), max(last[2], line[2]), max(last[3], line[3]), f"{last[4]}\n{line[4]}"]
            last[5] = line[1]
        else:
            blocks.append([*line, line[1]])
    return [tuple(b[:5]) for b in blocks]


def _target(pdf: File, holder: dict, numbers: dict[int, int]) -> tuple[str | None, int | None]:
    """The address or the page that a link or an entry of the outline leads to."""
    action = pdf.of(holder, "A")
    if isinstance(uri := pdf.get(action.get("URI")), bytes):
        return _text(uri), None
    place = pdf.get(holder.get("Dest", action.get("D")))
    root = pdf.of(pdf.trailer, "Root")
    if isinstance(place, (Name, bytes)):
        named, key = {**pdf.of(root, "Dests")}, str(place) if isinstance(place, Name) else _text(place)
        todo = [pdf.of(root, "Names").get("Dests")]
        while todo:
            node = pdf.get(todo.pop())
            if isinstance(node, dict):
                todo += pdf.of(node, "Kids", list)
                pairs = pdf.of(node, "Names", list)
                named |= {_text(pdf.get(k)): v for k, v in zip(pairs[::2], pairs[1::2])}
        place = pdf.get(named.get(key))
        place = pdf.get(place.get("D")) if isinstance(place, dict) else place
    if isinstance(place, list) and place:
        return None, numbers.get(place[0].number) if isinstance(place[0], Ref) else place[0] if isinstance(place[0], int) else None
    return None, None


def read(data: bytes) -> list[tuple]:
    """Rows kind, page, ord, label, text, target_text, target_page, box (or None), height of a file."""
    pdf = load(data)
    pages = _pages(pdf)
    numbers = {number: k for k, (number, _) in enumerate(pages)}
    labels, rows = _label(pdf, len(pages)), []
    for k, (_, page) in enumerate(pages):
        media = [float(pdf.get(x) or 0) for x in (pdf.get(page.get("MediaBox")) or [0, 0, 612, 792])]
        left, low, high = min(media[0], media[2]), min(media[1], media[3]), max(media[1], media[3])

        def box(x0: float, y0: float, x1: float, y1: float) -> tuple:
            return (min(x0, x1) - left, high - max(y0, y1), max(x0, x1) - left, high - min(y0, y1))

        runs, images = _shown(pdf, page)
        blocks = _blocks(runs)
        rows.append(("page", k, 0, labels[k], "\n".join(b[4] for b in blocks).strip(), None, None, None, high - low))
        rows += [("block", k, i, None, b[4], None, None, box(*b[:4]), high - low) for i, b in enumerate(blocks)]
        rows += [("image", k, i, None, None, None, None, box(*b), high - low) for i, b in enumerate(images)]
        links = [a for x in pdf.of(page, "Annots", list) if isinstance(a := pdf.get(x), dict) and a.get("Subtype") == "Link"]
        for i, link in enumerate(links):
            rect = [float(pdf.get(x) or 0) for x in pdf.of(link, "Rect", list)]
            rows.append(("link", k, i, None, None, *_target(pdf, link, numbers), box(*rect) if len(rect) == 4 else None, high - low))
    entry, depth, seen, i, later = pdf.of(pdf.of(pdf.trailer, "Root"), "Outlines").get("First"), 1, set(), 0, []
    while entry is not None or later:
        if entry is None:
            entry, depth = later.pop()
        item = pdf.get(entry)
        if not isinstance(item, dict) or (isinstance(entry, Ref) and entry.number in seen):
            entry = None
            continue
        if isinstance(entry, Ref):
            seen.add(entry.number)
        rows.append(("outline", None, i, str(depth), _text(pdf.get(item.get("Title"))), *_target(pdf, item, numbers), None, None))
        i += 1
        if item.get("Next") is not None:
            later.append((item["Next"], depth))
        entry, depth = item.get("First"), depth + 1
    return rows


def pages_of(data: bytes) -> list[tuple[str | None, str]]:
    """Label and text of each page."""
    return [(row[3], row[4]) for row in read(data) if row[0] == "page"]


def scan_pdf(files: DataFrame) -> DataFrame:
    """What each file (path, content) holds, one row for each page, block, image, link and entry of the outline, or one with the error."""
    names = [x.split()[0] for x in ROWS.split(", ")]
    sides = pa.struct([(s, pa.float64()) for s in ("x0", "y0", "x1", "y1")])
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), sides, pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    rows = [(path, *row[:7], None if row[7] is None else dict(zip(("x0", "y0", "x1", "y1"), row[7])), row[8], None) for row in read(content.as_py())]
                except Exception as error:  # a bad file is a result of its own
                    rows = [(path, "error", *[None] * 8, f"{type(error).__name__}: {error}")]
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return files.select("path", "content").mapInArrow(run, ROWS)


def pdf_blocks(scanned: DataFrame, doc_id: str = "path") -> dict[str, DataFrame]:
    """The tables that building documents takes, from rows of :func:`scan_pdf`: blocks, pages, images, links, labels, outline."""
    rows = scanned.withColumn("doc_id", F.col(doc_id))
    of = {k: rows.where(F.col("kind") == k) for k in ("block", "page", "image", "link", "outline")}
    return {
        "blocks": of["block"].select("doc_id", "page", (F.shiftleft(F.col("page").cast("bigint"), 32) + F.col("ord")).alias("pos"), "text", F.lit("text").alias("observed_type"), "box", "height"),
        "pages": of["page"].select("doc_id", "page", "text"),
        "images": of["image"].select("doc_id", "page", F.col("ord").alias("pos"), "box"),
        "links": of["link"].select("doc_id", "page", F.concat_ws(":", "page", "ord").alias("link_id"), "box", "target_text", "target_page"),
        "labels": of["page"].where("label is not null").select("doc_id", "label", F.concat(F.col("doc_id"), F.lit(":p"), F.col("page").cast("string")).alias("page_id")),
        "outline": of["outline"].select("doc_id", F.col("ord").alias("pos"), F.col("target_page").alias("page"), F.col("text").alias("title"), F.col("label").cast("int").alias("level")),
    }
