"""Hand-made PDF files."""

FRAME = "0 0 612 792 re S"


def pdf(content: str, trailer: str = "", info: str = "") -> bytes:
    objects = [
        "<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        "<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        f"<< /Length {len(content)} >>\nstream\n{content}\nendstream", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    ]
    if info:
        objects.append(f"<< /Title ({info}) >>")
    out, at = "%PDF-1.4\n", []
    for n, o in enumerate(objects, 1):
        at.append(len(out))
        out += f"{n} 0 obj\n{o}\nendobj\n"
    xref = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n" + "".join(f"{a:010d} 00000 n \n" for a in at)
    out += f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R{' /Info 6 0 R' if info else ''} >>\nstartxref\n{xref}\n%%EOF\n"
    return out.encode("latin-1") + trailer.encode()


def text(x: float, y: float, s: str) -> str:
    return f"BT /F1 12 Tf {x} {y} Td ({s}) Tj ET\n"


def table(x: float, y: float, rows: list[list[str]]) -> str:
    out = ""
    for r, row in enumerate(reversed(rows)):
        for c, cell in enumerate(row):
            out += f"{x + 100 * c} {y + 20 * r} 100 20 re S\n" + text(x + 100 * c + 5, y + 20 * r + 6, cell)
    return out
