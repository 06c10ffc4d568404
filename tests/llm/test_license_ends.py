import re

from kinweave.llm.licenses import NOTICES, TEXTS, scan


def kinds(text, label):
    return {kind for _, _, name, kind in scan(text)[2] if name == label}


def test_cut_bsd():
    whole = re.sub(r"<<any:\d>>|<<optional>>|<<end>>", "", TEXTS["bsd"][0])
    cut = whole[: whole.index("are disclaimed") + len("are disclaimed")]
    assert kinds(whole, "bsd") == {"text"} and not kinds(cut, "bsd")
    assert not kinds(whole.replace("even if advised", "even when advised"), "bsd")


def test_apache_is_a_notice():
    whole = NOTICES["apache-2"][-1].replace("<<any:8>>", "http www apache org licenses license 2 0")
    assert kinds(whole, "apache-2") == {"notice"} and max(end - start for start, end, *_ in scan(whole)[2]) == len(whole.split())
    assert "apache-2" not in TEXTS
