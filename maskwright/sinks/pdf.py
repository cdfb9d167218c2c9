"""Plain PDF files without outside libraries: text pages, page images, and the text of simple files."""

from __future__ import annotations

import re
import zlib

import numpy as np

from maskwright.operators.pages import LINE_BYTES, PAGE_LINES, wrap_line

#: A4 in points, Courier at ten points, twelve points a line.
PAGE_SIZE, FONT_SIZE, LEADING, MARGIN = (595, 842), 10, 12, 50
#: US letter in points, for page images.
IMAGE_PAGE = (612, 792)
MAX_PAGES = 500


def page_lines(text: str) -> list[list[str]]:
    """Wrapped lines in pages; an empty text has one empty page."""
    body = text[:-1] if text.endswith("\n") else text
    lines = [chunk for line in body.split("\n") for chunk in wrap_line(line.removesuffix("\r"), LINE_BYTES)] if text else [""]
    return [lines[i : i + PAGE_LINES] for i in range(0, len(lines), PAGE_LINES)] or [[""]]


def _file(objects: list[bytes]) -> bytes:
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at))


def _stream(data: bytes, head: bytes = b"") -> bytes:
    packed = zlib.compress(data)
    return b"<< /Length %d /Filter /FlateDecode " % len(packed) + head + b">>\nstream\n" + packed + b"\nendstream"


def write_pdf(text: str) -> bytes:
    """The text on A4 pages in Courier; characters outside Latin-1 become question marks."""
    pages = page_lines(text)
    kids = b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(pages)), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    for i, lines in enumerate(pages):
        shown = b"".join(b"(%s) Tj T*\n" % re.sub(rb"([\\()])", rb"\\\1", line.encode("latin-1", "replace")) for line in lines)
        content = b"BT /F1 %d Tf %d TL %d %d Td\n" % (FONT_SIZE, LEADING, MARGIN, PAGE_SIZE[1] - MARGIN) + shown + b"ET"
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (*PAGE_SIZE, 5 + 2 * i))
        objects.append(_stream(content))
    return _file(objects)


def images_pdf(images: list[np.ndarray], covers: list[list[tuple[int, int, int, int, str]]] | None = None) -> bytes:
    """Grey page images (height x width, uint8), one a page, filling US letter pages.

    ``covers`` are for each page boxes (x, y, w, h, text) in pixels of its image; the text is set into the box. More than
    ``MAX_PAGES`` pages raise.
    """
    if len(images) > MAX_PAGES:
        raise ValueError(f"more than {MAX_PAGES} pages")
    kids = b" ".join(b"%d 0 R" % (4 + 3 * i) for i in range(len(images)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(images)), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for i, image in enumerate(images):
        h, w = image.shape
        sx, sy = IMAGE_PAGE[0] / max(w, 1), IMAGE_PAGE[1] / max(h, 1)
        words = b""
        for x, y, bw, bh, text in covers[i] if covers else ():
            shown = re.sub(rb"([\\()])", rb"\\\1", text.encode("latin-1", "replace"))
            words += b"BT /F1 %.2f Tf %.2f %.2f Td (%s) Tj ET\n" % (text_size(bh, bw, len(text)) * sy, x * sx, IMAGE_PAGE[1] - (y + 0.8 * bh) * sy, shown)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> /XObject << /I %d 0 R >> >> /Contents %d 0 R >>" % (*IMAGE_PAGE, 6 + 3 * i, 5 + 3 * i))
        objects.append(_stream(b"q %d 0 0 %d 0 0 cm /I Do Q\n" % IMAGE_PAGE + words))
        objects.append(_stream(image.astype(np.uint8).tobytes(), b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceGray /BitsPerComponent 8 " % (w, h)))
    return _file(objects)


def paint_boxes(image: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """A copy of a page image with the boxes (x, y, w, h) painted white; what lies outside the image is left out."""
    out = image.copy()
    for x, y, w, h in boxes:
        out[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)] = 255
    return out


def text_size(mean_height: float, box_width: int, characters: int) -> int:
    """Pixels of the cover text in a box: 0.85 of the words' mean height, smaller to fit the width, at least 24."""
    return int(max(24, min(0.85 * mean_height, box_width / max(1, characters) / 0.6)))


_OBJECT = re.compile(rb"(\d+) \d+ obj(.*?)endobj", re.DOTALL)
_TEXT = re.compile(rb"\((?P<one>(?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[(?P<many>(?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ|(?P<line>T\*|-?[\d.]+\s+-?[\d.]+\s+T[dD]\b)", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> str:
    plain = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), raw, flags=re.DOTALL)
    return plain.decode("latin-1")


def pdf_text(content: bytes) -> str:
    """Text of the pages in order for files with simple fonts and plain or deflated streams; raises for what is no PDF."""
    if not content.startswith(b"%PDF-"):
        raise ValueError("not a PDF file")
    if b"/Encrypt" in content:
        raise ValueError("encrypted PDF file")
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}
    pages = []
    for body in objects.values():
        if not re.search(rb"/Type\s*/Page\b", body):
            continue
        refs = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+) \d+ R)", body)
        parts = [int(n) for n in re.findall(rb"(\d+) \d+ R", refs[1])] if refs and refs[1] else [int(refs[2])] if refs else []
        out: list[str] = []
        for n in parts:
            m = re.search(rb"stream\r?\n(.*?)\r?\nendstream", objects.get(n, b""), re.DOTALL)
            data = zlib.decompress(m[1]) if m and b"FlateDecode" in objects[n] else m[1] if m else b""
            for t in _TEXT.finditer(data):
                if t["line"]:
                    out.append("\n")
                else:
                    out.append(_literal(t["one"]) if t["one"] is not None else "".join(_literal(x) for x in re.findall(rb"\(((?:\\.|[^\\()])*)\)", t["many"])))
        pages.append("".join(out).strip("\n"))
    return "\n".join(pages)
