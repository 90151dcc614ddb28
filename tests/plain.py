"""Plain Python versions of the queries that SQL can't express, over the supplied tables."""

from __future__ import annotations

import hashlib
import html
import json
import re

import pandas as pd

from corpusloom import models
from corpusloom.functions import redaction

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
size = lambda s: len(s.encode())


def merged(pieces, limit, overlap):
    """Chunks from pieces: as many as fit; the next one starts with the last of them that the overlap allows."""
    out, now = [], []
    for p in pieces:
        if now and sum(map(size, now)) + size(p) > limit:
            out.append("".join(now))
            while now and (sum(map(size, now)) > overlap or sum(map(size, now)) + size(p) > limit):
                now = now[1:]
        now = [*now, p]
    return [c.strip() for c in [*out, "".join(now)] if c.strip()]


def split(text, limit=1500, overlap=200, separators=("\n\n", "\n", ". ", " ", "")):
    while separators[0] not in text:
        separators = separators[1:]
    mark, finer = separators[0], separators[1:]
    pieces = [p for p in re.split(f"(?={re.escape(mark)})", text) if p] if mark else list(text)
    out, run = [], []
    for p in pieces:
        if finer and size(p) >= limit:
            out, run = out + merged(run, limit, overlap) + split(p, limit, overlap, finer), []
        else:
            run.append(p)
    return out + merged(run, limit, overlap)


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = 2 * d if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def redacted(text):
    """The document policy: text and finds."""
    counts, dot = {}, "\x1c"

    def put(entity, pattern, keep=lambda m: False):
        nonlocal text

        def one(m):
            if keep(m):
                return m[0]
            counts[entity] = counts.get(entity, 0) + 1
            return f"<{entity}>"

        text = re.sub(pattern, one, text)

    put("EMAIL_ADDRESS", redaction.EMAIL)
    put("CREDIT_CARD", redaction.CARD, lambda m: not luhn(re.sub("[ -]", "", m[0])))
    put("PHONE_NUMBER", redaction.PHONE)
    text = re.sub("(?i)" + redaction.SECTION.replace("(?iU)", ""), rf"\1\2{dot}\3{dot}\4{dot}\5", text)
    put("IP_ADDRESS", redaction.IP)
    text = text.replace(dot, ".")
    put("CA_SIN", redaction.SIN)
    return text, counts


def chunks(data):
    d = pd.read_parquet(data / "documents.parquet")
    return [(r.doc_id, 0, k, sha(f"{r.doc_id}:0:{k}"), text, r.source, r.lang) for r in d.itertuples() if r.text for k, text in enumerate(split(r.text))]


def chunk_documents(data):
    return pd.DataFrame([(d, s, k, i, sha(t), t) for d, s, k, i, t, _, _ in chunks(data)], columns=["document_id", "section", "part", "chunk_id", "content_hash", "text"])


def _prepared(data):
    for d, _, _, chunk_id, text, title, heading in chunks(data):
        safe, a = redacted(text)
        prompt, b = redacted(f"{title}\n{heading}\n\n{safe}")
        yield d, chunk_id, prompt, {k: a.get(k, 0) + b.get(k, 0) for k in [*a, *(k for k in b if k not in a)]}


def prepared_chunks(data):
    rows = [(i, sha(p), size(p) <= 1900, json.dumps(dict(sorted(c.items())), separators=(",", ":"))) for _, i, p, c in _prepared(data)]
    return pd.DataFrame(rows, columns=["chunk_id", "content_hash", "prompt_ok", "redactions"])


def per_document_counts(data):
    f = pd.DataFrame([(d, sum(c.values())) for d, _, _, c in _prepared(data)], columns=["document_id", "redactions"])
    g = f.groupby("document_id")["redactions"].agg(["size", "sum"]).reset_index()
    return pd.DataFrame({"document_id": g["document_id"], "sections": 1, "chunks": g["size"], "redactions": g["sum"]})


_TOKEN = re.compile(r"<!--.*?-->|<![^>]*>|<(?P<raw>script|style)\b[^>]*>.*?</(?P=raw)>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<attrs>[^>]*)>|(?P<text>[^<]+)", re.S)
_ALONE = {"br", "hr", "img", "input", "link", "meta"}
_DROPPED, _HEADS, _BLOCKS = {"nav", "header", "footer", "form", "aside"}, {"h1", "h2", "h3", "h4", "h5"}, {"p", "li", "tr"}


def page_sections(page):
    """Sections by the intervals of elements over the page's tokens; None without an article."""
    opened, elements, texts = [], [], []  # elements: [tag, attrs, first token, last token, enclosing element]
    for n, m in enumerate(_TOKEN.finditer(page)):
        if m["text"] and not m["raw"]:
            texts.append((n, html.unescape(m["text"])))
        elif m["tag"] and m["end"]:
            at = next((k for k in range(len(opened) - 1, -1, -1) if elements[opened[k]][0] == m["tag"].lower()), None)
            for k in opened[at:] if at is not None else []:
                elements[k][3] = n
            opened = opened[:at] if at is not None else opened
        elif m["tag"]:
            elements.append([m["tag"].lower(), m["attrs"], n, None, opened[-1] if opened else None])
            if elements[-1][0] not in _ALONE:
                opened.append(len(elements) - 1)
    last = 1 << 60
    span = lambda e: (e[2], e[2] if e[0] in _ALONE else e[3] or last)
    body = next((span(e) for e in elements if e[0] == "article"), None)
    if body is None:
        return None
    gone = [span(e) for e in elements if e[0] in _DROPPED or re.search(r'class="(?:[^"]* )?(?:wb-)?toc(?: [^"]*)?"', e[1])]
    inside = lambda n, s: s[0] < n < s[1]
    lost = lambda n: any(s[0] <= n <= s[1] and s[0] > body[0] for s in gone)
    out, heading, anchor, blocks = [], "Overview", None, []
    name = lambda e: (re.search(r'\bid="([^"]*)"', e[1]) or [None, None])[1]
    for e in elements:
        if not inside(e[2], body) or lost(e[2]) or e[0] not in _HEADS | _BLOCKS:
            continue
        if e[0] in ("p", "li") and any(x[0] in ("li", "tr") and inside(e[2], span(x)) and inside(x[2], body) for x in elements):
            continue
        words = " ".join(t.strip() for n, t in texts if inside(n, span(e)) and not lost(n) and t.strip())
        words = re.sub(r"\s+", " ", words).strip()
        if not words:
            continue
        if e[0] in _BLOCKS:
            blocks.append(words)
            continue
        if blocks:
            out.append((heading, "\n\n".join(blocks), anchor))
        heading, blocks, anchor = words, [], name(e) or (name(elements[e[4]]) if e[4] is not None else None) or None
    return out + ([(heading, "\n\n".join(blocks), anchor)] if blocks else [])


def html_sections(data):
    p = pd.read_parquet(data / "pages.parquet")
    rows = [(r.page_id, k, h, t, a, None) for r in p.itertuples() for k, (h, t, a) in enumerate(page_sections(r.html or "") or [])]
    return pd.DataFrame(rows, columns=["page_id", "section", "heading", "text", "anchor", "page"])


def embedded_documents(data):
    d = pd.read_parquet(data / "documents.parquet")
    embed = models.hashed_embedder(64)()
    texts = {sha(t or ""): t or "" for t in d["text"]}
    return pd.DataFrame([(h, embed([redacted(t)[0]])[0]) for h, t in texts.items()], columns=["content_hash", "embedding"])


VERSIONS = {f.__name__: f for f in (chunk_documents, prepared_chunks, per_document_counts, html_sections, embedded_documents)}
