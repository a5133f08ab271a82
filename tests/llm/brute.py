"""Plain reimplementations that the operators are held against."""

from __future__ import annotations

import collections
import html.parser
import math
import zlib

from quantloom.llm.quality import STOP_WORDS


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = words(text)
    if len(w) >= n:
        return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    return frozenset([tuple(w)] if w else [])


def components(nodes, edges) -> dict:
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_components(docs: dict[int, str | None], percent: int = 85) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in docs.items()}
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    both = collections.Counter((a, b) for v in where.values() for k, b in enumerate(v) for a in v[:k])
    return components(sets, [p for p, n in both.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)])


def fold(doc_id, parts: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def base_scores(rows: list[tuple]) -> tuple[int, dict]:
    """N, and (n_tokens, n_known, base score) by row number."""
    tokens = [[*words(t), None] for _, t in rows]
    counts = collections.Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if fold(i, 5) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    out = {k: (len(ws), sum(counts[w] > 0 for w in ws), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for k, ws in enumerate(tokens)}
    return n, out


def model_scores(rows: list[tuple]) -> list[float]:
    """The language model's scores by row, from exact counts quantised to levels of a factor of 1.5."""
    texts = [["<", *words(t), ">"] for _, t in rows]
    single, pairs = collections.Counter(), collections.Counter()
    for (i, _), ws in zip(rows, texts, strict=True):
        if fold(i, 5) != 1:
            single.update(ws)
            pairs.update(zip(ws, ws[1:], strict=False))
    n, v = sum(single.values()) - single["<"], len(single) - ("<" in single)

    def mean(count: int) -> float:
        if not count:
            return 0.0
        k = math.floor(math.log(count) / math.log(1.5) + 1e-9)
        low = math.ceil(1.5**k)
        return (low + max(low, math.ceil(1.5 ** (k + 1)) - 1)) / 2

    out = []
    for ws in texts:
        total = 0.0
        for a, b in zip(ws, ws[1:], strict=False):
            p, of = (mean(single[b]) + 0.5) / (n + 0.5 * (v + 1)), mean(single[a])
            total += math.log10((min(mean(pairs[a, b]), of) + 4.0 * p) / (of + 4.0))
        out.append(total)
    return out


class _Blocks(html.parser.HTMLParser):
    """[text, characters in links, in an article, furniture, heading] of each block of a page whose elements are closed or <b>."""

    BREAK = {"p", "li", "div", "article", "h1", "ul", "nav", "footer", "br", "section", "header", "body", "form"}

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.open, self.out, self.now = [], [], []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = " ".join("".join(t for t, _ in self.now).split())
        if text:
            linked = sum(len(" ".join(t.split())) for t, link in self.now if link)
            names = [t for t, _ in self.open]
            bad = any(t in ("nav", "footer", "aside", "header") or c in ("ad", "comments", "cookie-notice") for t, c in self.open)
            self.out.append([text, linked, "article" in names, bad, "h1" in names])
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAK:
            self.end()
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self.open.pop()
        if tag not in ("b", "br", "meta", "input"):
            self.open.append((tag, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        if tag in self.BREAK:
            self.end()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if not any(t in ("script", "style", "title", "form") for t, _ in self.open):
            self.now.append((data, any(t == "a" for t, _ in self.open)))


def page_text(page: str) -> str:
    """Main text of a page in words with spaces, of one article at most, by the two passes, each block looked at alone."""
    blocks, labels = _Blocks(page).out, []
    split = lambda text: [w.strip(".,;:!?\"'()") for w in text.lower().split()]
    every = [w for b in blocks if not b[3] for w in split(b[0])]
    known = 10 * sum(w in STOP_WORDS for w in every) >= len(every)
    for text, linked, article, bad, _ in blocks:
        words = split(text)
        stops = sum(w in STOP_WORDS if known else len(w) <= 3 for w in words) / len(words)
        if sum(map(len, words)) > 15 * len(words):
            stops = 1.0
        if linked / len(text) > (0.5999999 if article else 0.25) or bad:
            labels.append("bad")
        elif len(text) < 70:
            labels.append("short")
        elif stops >= 0.25:
            labels.append("good" if len(text) > 200 else "near")
        else:
            labels.append("near" if stops >= 0.15 or article else "bad")
    out = []
    for k, (text, linked, article, _, heading) in enumerate(blocks):
        label = labels[k]
        if label not in ("good", "bad"):
            seen = [n for n in range(len(blocks)) if labels[n] in ("good", "bad") and (blocks[n][2] or not article)]
            sides = [*[n for n in seen if n < k][-1:], *[n for n in seen if n > k][:1]]
            ahead = [n for n in sides if k < n <= k + 2]
            if not sides:
                label = "good" if article or label == "near" or not linked else "bad"
            elif heading and ahead:
                label = labels[ahead[0]]
            elif label == "near":
                label = "good" if any(labels[n] == "good" for n in sides) else "bad"
            else:
                label = min((abs(n - k), labels[n] == "bad", labels[n]) for n in sides)[2]
        if label == "good":
            out.append(text)
    return " ".join(out)
