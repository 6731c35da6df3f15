"""The HTML tokenizer against a reader of one character at a time, on made-up markup."""

import random
import time
from html import unescape

from pyspark.sql import functions as F

from lakeloom.functions import html as H

SPACE = " \t\n\r\f"


def naive(s):
    """Tokens by the standard's states, a character at a time."""
    out, text, i, n = [], "", 0, len(s)

    def flush():
        nonlocal text
        if text:
            out.append(("text", unescape(text), {}))
        text = ""

    while i < n:
        c = s[i]
        if c != "<":
            text += c
            i += 1
            continue
        nxt = s[i + 1] if i + 1 < n else ""
        if nxt == "!" and s[i : i + 4] == "<!--":
            flush()
            i += 4
            if s[i : i + 1] == ">":
                i += 1
            elif s[i : i + 2] == "->":
                i += 2
            else:
                while i < n and s[i : i + 3] != "-->" and s[i : i + 4] != "--!>":
                    i += 1
                i += 3 if s[i : i + 3] == "-->" else 4
            continue
        closing = nxt == "/"
        first = s[i + 2] if closing and i + 2 < n else "" if closing else nxt
        if closing and not first:
            text += "</"
            break
        if not (first.isascii() and first.isalpha()):
            if closing or nxt in ("!", "?") and nxt:
                flush()
                i += 2
                while i < n and s[i] != ">":
                    i += 1
                i += 1
            else:
                text += c
                i += 1
            continue
        flush()
        i += 2 if closing else 1
        name = ""
        while i < n and s[i] not in SPACE + "/>":
            name += s[i]
            i += 1
        name, attributes, ended = name.lower(), {}, False
        while i < n:
            if s[i] == ">":
                ended, i = True, i + 1
                break
            if s[i] in SPACE + "/":
                i += 1
                continue
            key, value = s[i], ""
            i += 1
            while i < n and s[i] not in SPACE + "/>=":
                key += s[i]
                i += 1
            j = i
            while j < n and s[j] in SPACE:
                j += 1
            if j < n and s[j] == "=":
                i = j + 1
                while i < n and s[i] in SPACE:
                    i += 1
                if i < n and s[i] in "\"'":
                    quote, i = s[i], i + 1
                    while i < n and s[i] != quote:
                        value += s[i]
                        i += 1
                    if i >= n:
                        break
                    i += 1
                else:
                    while i < n and s[i] not in SPACE + ">":
                        value += s[i]
                        i += 1
            attributes.setdefault(key.lower(), unescape(value))
        if not ended:
            break
        if closing:
            out.append(("end", name, {}))
            continue
        out.append(("start", name, attributes))
        if name in H.RAW | H.ESCAPABLE:
            raw = ""
            while i < n and not (s[i : i + 2] == "</" and s[i + 2 : i + 2 + len(name)].lower() == name and s[i + 2 + len(name) : i + 3 + len(name)] in list(SPACE + "/>")):
                raw += s[i]
                i += 1
            if raw and name in H.ESCAPABLE:
                out.append(("text", unescape(raw), {}))
    flush()
    return out


def joined(found):
    """Neighbouring texts as one: where a text is cut says nothing."""
    out = []
    for kind, name, attributes in found:
        if out and kind == "text" == out[-1][0]:
            out[-1] = ("text", out[-1][1] + name, {})
        else:
            out.append((kind, name, attributes))
    return out


def test_tokens_of_made_up_markup():
    parts = ["<", ">", "</", "/>", "<!--", "-->", "--!>", "<!", "<?x", "p", "b>", "<p>", "</p>", "<P a=1 A=2 b='x>y' c=\"q\">", "<br/>", "<script>", "</script>", "</SCRIPT >", "<title>", "</title>", "<style", "a", " ", "\n", "=", "'", '"', "&amp;", "&lt", "&#65;", "&", "é", "<é", "<1", "</>", "</ p>", "text", "-", "!"]
    r = random.Random(1)
    for _ in range(30_000):
        s = "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        assert joined(H.tokens(s)) == joined(naive(s)), s


def test_blocks():
    page = "<title>T</title><p>a <b>b<br>c</b>&nbsp;d<p>e<!-- x --> f<script>g</script><select><option>h</select><ul><li>i<li>j</ul>k &lt; l"
    assert H.blocks(page) == ["a b c d", "e f", "i", "j", "k < l"]
    assert H.blocks("") == [] and H.blocks("<p") == []


def test_tokens_are_read_in_linear_time():
    for part in ("<a '", "<!--", "<div>", "<script>", "<b x=", "&amp", "</", "<title>", "<!", "<a ", "=\"", "<p/"):
        began = time.perf_counter()
        for _ in H.tokens(part * (1_000_000 // len(part))):
            pass
        assert time.perf_counter() - began < 5, part


def test_html_to_text_of_odd_pages(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a<p>b"), (None, "x"), (3, "<p>a<p>b")], "page_id long, html string").withColumn("text", F.lit("other"))
    got = H.html_to_text(df, "html", ["page_id"]).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "x"), (1, ""), (2, ""), (3, "a\nb"), (3, "a\nb")]
    assert H.html_to_text(df.limit(0), "html", ["page_id"]).count() == 0
