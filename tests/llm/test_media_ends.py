import io
import zipfile

from kinweave.llm.media import sniff

PDF = b"%PDF-1.4 x startxref 0 %%EOF"


def stored(name, data):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, data)
        z.writestr("last", "b")
    return out.getvalue()


def test_updated_pdf():
    whole = PDF + b" more startxref 9 %%EOF"
    assert sniff(whole, "application/pdf") == ("application/pdf", len(whole), False, [])
    assert sniff(whole + b" a word on %%EOF", None)[1] == len(whole)
    assert sniff(whole + PDF, None)[1:] == (len(whole), True, [(len(whole), len(PDF), "application/pdf")])


def test_zip_in_zip():
    inner = stored("a", "b")
    whole = stored("inner.zip", inner)
    kind, length, _, carved = sniff(whole + b"tail", None)
    assert (kind, length) == ("application/zip", len(whole)) and (whole.index(inner), len(inner), "application/zip") in carved
    assert sniff(whole[:-1], None)[0] != "application/zip"
