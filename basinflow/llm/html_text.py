"""Main text of web pages: a bidirectional LSTM in numpy labels every block of a page from the whole page's sequence of blocks.

A page is cut into blocks at block-level tags. A block is read as hashed tags and classes of its path, hashed words, and a few
measures (length, share of link text, place in the page). Both directions of the LSTM pass over all blocks, so that each label
rests on the whole page. It is fitted here, on TRAIN_PAGES pages chosen by a hash of page_id, towards blocks whose path itself
names them (an article or main part; menus, headers, footers, asides, forms, adverts, notices, comments); blocks without such
evidence don't count in fitting. Each page is learned as it is, without its names and telling tags (text, links and context decide
where a page names nothing), and in other shapes, SHAPES in all however few pages there are: main text in other places and as
headings, lists, tables, code or a few words, other blocks dropped, moved and under made-up names, so that no one template is
learned. Fitting is deterministic. Inference keeps no trace and takes pages of like length together, CELLS blocks with padding at a
time.

Defined cases: null or empty html gives an empty text; a page without a block of main text too; repeated rows get equal rows; a
null page_id or url is carried along; without any page there is nothing to fit and no rows. Other columns are not looked at, whatever
their names. Tags at any depth count: below NAMED levels a path still takes every name that changes what it gives evidence of.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm.common import portions
from basinflow.session import ship

TRAIN_PAGES, SHAPES, EPOCHS, BATCH_PAGES, RATE, DECAY = 192, 1920, 12, 16, 0.02, 0.03
#: Pages labelled by one call, and padded blocks at a time.
TOGETHER, CELLS = 256, 1 << 14
PATH_WIDTH, WORD_WIDTH, MEASURES, HIDDEN = 96, 24, 6, 16
WIDTH = PATH_WIDTH + WORD_WIDTH + MEASURES

RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "select")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = "p"
#: Open tags that a tag ends by itself.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
#: Attributes up to the tag's end: quotes only count where a value begins; a value without them ends at white space or >.
ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+"
MARKUP = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<svg(?=[\s/>]){ATTRIBUTES}(?<=/)>|<({'|'.join(RAW)})(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})>|<[/!?a-zA-Z][^>]*+>",
    re.S | re.I,
)
NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))""", re.I)
#: Levels whose tags and names a path holds in full; below them, only names that change its evidence.
NAMED = 64
MAIN = frozenset("article main".split())
ASIDE_TAGS = frozenset("nav header footer aside form head title button dialog menu".split())
ASIDE_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|menu|nav\w*|newsletter|notice|popup|promo\w*|related|respond|share|sidebar|social|sponsor\w*|subscribe)(?:$|[-_ ])",
    re.I,
)


def blocks(page: str | None) -> list[Block]:
    """(path, text, link characters) of each block with text, in page order. A path names tags and classes from the root down."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # tags and their paths
    opened: Counter[str] = Counter()
    parts: list[str] = []
    links, in_link = 0, 0

    def end_block() -> None:
        nonlocal links, parts
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((stack[-1][1] if stack else (), text, min(links, len(text))))
        parts, links = [], 0

    def add(text: str) -> None:
        nonlocal links
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            links += len(text) if in_link else 0

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    at, page = 0, page or ""
    for match in MARKUP.finditer(page):
        add(page[at : match.start()])
        at = match.end()
        tag = (match[3] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if match[2] else 1
            elif tag in ("br", "img"):
                parts.append(" ")
            continue
        end_block()
        in_link = 0
        if match[2]:
            if opened[tag]:
                while pop() != tag:
                    pass
            continue
        if stack and stack[-1][0] == CLOSES_P:
            pop()
        while stack and stack[-1][0] in ENDS.get(tag, ()):
            pop()
        if tag not in VOID and not match[4].rstrip().endswith("/"):
            path = stack[-1][1] if stack else ()
            names = (tag, *(x for m in NAMES.finditer(match[4]) for group in m.groups() if group for x in group.split()))
            if len(stack) < NAMED:
                path = (*path, *names)
            elif (telling := tuple(x for x in names if x in MAIN or aside(x))) and evidence(path + telling) != evidence(path):
                path += telling
            stack.append((tag, path))
            opened[tag] += 1
    add(page[at:])
    end_block()
    return out


def aside(name: str) -> bool:
    return name in ASIDE_TAGS or ASIDE_NAMES.search(name) is not None


def evidence(path: tuple[str, ...]) -> int:
    """1: main text by its path; 0: not; -1: the path doesn't say."""
    if any(map(aside, path)):
        return 0
    return 1 if any(x in MAIN for x in path) else -1


#: Tags that say nothing of what a block is.
NEUTRAL = frozenset("html body div section p ul ol li h1 h2 h3 h4 h5 h6 table tbody thead tr td th dl dt dd blockquote pre figure figcaption".split())


def unnamed(page: list[Block]) -> list[Block]:
    """The page with neutral tags alone in its paths."""
    return [(tuple(x for x in path if x in NEUTRAL), text, links) for path, text, links in page]


#: Shapes of varied copies: where main text and other blocks stand and how paths of main text end. A ? is a made-up name.
MAIN_PLACES = (("article",), ("article", "?"), ("main",), ("main", "div"), ("main", "article"), ("div", "?", "article"), ("div", "?"), ("div",))
MAIN_ENDS = (
    ("p",), ("p",), ("p",), ("h2",), ("h3",), ("ul", "li"), ("ul", "?", "li"), ("ol", "li"), ("table", "tr", "td"), ("table", "tbody", "tr", "th"), ("pre",),
    ("blockquote",), ("blockquote", "p"), ("dl", "dt"), ("dl", "dd"), ("section", "p"), ("div",), ("div", "?", "p"), ("figure", "figcaption"),
)
OTHER_PLACES = (
    ("nav",), ("nav", "ul", "li"), ("header",), ("header", "div", "?"), ("footer",), ("footer", "p"), ("aside", "p"), ("aside", "ul", "li"), ("form",), ("div", "ad"), ("div", "sidebar", "ul", "li"),
    ("div", "comments"), ("section", "comments", "p"), ("div", "related", "li"), ("div", "cookie-notice"), ("div", "?"), ("div", "?", "p"), ("section", "?", "p"), ("ul", "?", "li"), ("div", "?", "ul", "li"), ("p",),
)
Block = tuple[tuple[str, ...], str, int]


def varied(page: list[Block], marks: list[int], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The page's marked blocks in another shape, with their marks.

    Only where the place names main text do blocks shrink to a few words, texts of any two blocks change places, and passages of
    main text turn up outside as comments.
    """
    draw = lambda options: options[rng.integers(len(options))]
    named = lambda path: tuple(f"{rng.integers(1 << 40):x}" if x == "?" else x for x in path)
    few = lambda text, n: " ".join(text.split()[:n])
    root = ("html", "body") if rng.random() < 0.8 else ()
    place = (*root, *named(draw(MAIN_PLACES)))
    told = evidence(place) == 1
    brief = 0.6 if told and rng.random() < 0.5 else 0.0
    main = [k for k, mark in enumerate(marks) if mark == 1]
    others = [block for block, mark in zip(page, marks) if mark == 0]
    if rng.random() < 0.5:  # a short page
        first = int(rng.integers(max(1, len(main))))
        main = main[first : first + int(rng.integers(1, 7))]
    kept, last = frozenset(main), max(main, default=-1)
    out: list[tuple[Block, int]] = []

    def elsewhere(blocks: list[Block], inside: tuple[str, ...] = ()) -> None:
        """Blocks that are not main text, together in one other place."""
        where = named(draw(OTHER_PLACES))
        if inside or not told:
            while evidence(where) != 0 and (inside or rng.random() < 0.5):
                where = named(draw(OTHER_PLACES))
        out.extend((((*(inside or root), *where), text, links), 0) for _, text, links in blocks)

    end, at = ("p",), 0
    while at < len(page):
        path, text, links = page[at]
        run = at + 1
        if marks[at] == 1:
            if at in kept:
                if rng.random() < 0.4:
                    end = named(draw(MAIN_ENDS))
                if rng.random() < brief:
                    text = few(text, int(rng.integers(1, 5)))
                elif rng.random() < 0.15:
                    text = re.split(r"(?<=[.!?])\s", text, maxsplit=1)[0]
                out.append((((*place, *end), text, min(links, len(text))), 1))
                if others and told and rng.random() < 0.06:
                    elsewhere([draw(others)], place)
        elif marks[at] == 0:
            while run < len(page) and marks[run] == 0 and page[run][0] == path:
                run += 1
            if "head" in path:
                out.append((page[at], 0))
            elif rng.random() < 0.75:
                elsewhere(page[at:run])
        if at == last and told and rng.random() < 0.5:  # readers' comments
            elsewhere([((), few(page[draw(main)][1], int(rng.integers(1, 25))), 0) for _ in range(rng.integers(1, 6))])
        at = run
    if told and rng.random() < 0.5:
        texts = [block[1:] for block, _ in out]
        out = [((path, *(draw(texts) if rng.random() < 0.5 else rest)), mark) for (path, *rest), mark in out]
    return [block for block, _ in out], [mark for _, mark in out]


def _hashed(items, width: int) -> np.ndarray:
    out = np.zeros(width, np.float32)
    for item in items:
        h = zlib.crc32(item.encode())
        out[h % width] += 1.0 if h & 0x10000 else -1.0
    return out / max(1.0, float(np.sqrt((out * out).sum())))


def features(page: list[Block], memo: dict) -> np.ndarray:
    out = np.zeros((len(page), WIDTH), np.float32)
    for k, (path, text, links) in enumerate(page):
        if path not in memo:
            if len(memo) > 10_000:
                memo.clear()
            memo[path] = _hashed(dict.fromkeys(path), PATH_WIDTH)
        words = text.split()
        out[k, :PATH_WIDTH] = memo[path]
        out[k, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] = _hashed(words, WORD_WIDTH)
        out[k, -MEASURES:] = (
            np.log1p(len(text)) / 8, links / len(text), np.log1p(len(words)) / 6, min(1.0, sum(map(text.count, ".!?;")) / (1 + len(words))), (k + 1) / (len(page) + 1), min(len(path), 16) / 16,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """One LSTM each way over padded sequences [time, page, feature] and a logistic output."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None) -> None:
        if weights is None:
            rng = np.random.default_rng(7)
            normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
            weights = {"out": normal(2 * HIDDEN, 1)[:, 0], "out_b": np.zeros(1, np.float32)}
            for way in "fb":
                weights |= {f"{way}x": normal(WIDTH, 4 * HIDDEN), f"{way}h": normal(HIDDEN, 4 * HIDDEN), f"{way}b": np.zeros(4 * HIDDEN, np.float32)}
                weights[f"{way}b"][HIDDEN : 2 * HIDDEN] = 1.0
        self.w = weights

    def _pass(self, way: str, x: np.ndarray, mask: np.ndarray, trace: list | None = None) -> np.ndarray:
        steps, pages, _ = x.shape
        h = c = np.zeros((pages, HIDDEN), np.float32)
        inputs = x @ self.w[f"{way}x"] + self.w[f"{way}b"]
        out = np.empty((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if way == "f" else reversed(range(steps)):
            z = inputs[t] + h @ self.w[f"{way}h"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            tanh = np.tanh(new)
            m = mask[t][:, None]
            if trace is not None:
                trace.append((t, h, c, i, f, o, g, tanh))
            h, c = np.where(m, o * tanh, h), np.where(m, new, c)
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, traces: dict[str, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([self._pass(way, x, mask, None if traces is None else traces.setdefault(way, [])) for way in "fb"], axis=2)
        return both @ self.w["out"] + self.w["out_b"], both

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over labels 0 and 1; -1 doesn't count."""
        traces: dict[str, list] = {}
        logits, both = self.logits(x, mask, traces)
        counted = mask & (labels >= 0)
        d = np.where(counted, _sigmoid(logits) - labels, 0) / max(1, counted.sum())
        grads = {"out": np.einsum("tp,tph->h", d, both), "out_b": np.array([d.sum()])}
        for k, way in enumerate("fb"):
            d_out = d[:, :, None] * self.w["out"][k * HIDDEN : (k + 1) * HIDDEN]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            g_h = np.zeros_like(self.w[f"{way}h"])
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, tanh in reversed(traces[way]):
                m = mask[t][:, None]
                dh = dh + d_out[t]
                through = np.where(m, dh, 0)
                d_new = np.where(m, dc, 0) + through * o * (1 - tanh * tanh)
                dz = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), through * tanh * o * (1 - o), d_new * i * (1 - g * g)], axis=1)
                dz_all[t] = dz
                g_h += h.T @ dz
                dh = np.where(m, 0, dh) + dz @ self.w[f"{way}h"].T
                dc = np.where(m, d_new * f, dc)
            grads |= {f"{way}x": np.einsum("tpd,tpz->dz", x, dz_all), f"{way}h": g_h, f"{way}b": dz_all.sum(axis=(0, 1))}
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Adam over batches of pages of like length, at a rate that falls to nothing, with weights drawn towards zero."""
        pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
        groups = [padded(pages[k : k + BATCH_PAGES]) for k in range(0, len(pages), BATCH_PAGES)]
        mean = {n: np.zeros_like(v) for n, v in self.w.items()}
        square = {n: np.zeros_like(v) for n, v in self.w.items()}
        rng, step = np.random.default_rng(11), 0
        steps = EPOCHS * len(groups)
        for _ in range(EPOCHS):
            for k in rng.permutation(len(groups)):
                step += 1
                for name, grad in self.gradients(*groups[k]).items():
                    mean[name] = 0.9 * mean[name] + 0.1 * grad
                    square[name] = 0.99 * square[name] + 0.01 * grad * grad
                    change = (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)
                    self.w[name] = (self.w[name] - RATE * (1 - step / (steps + 1)) * (change + DECAY * self.w[name])).astype(np.float32)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            n = len(order)
            while n > 1 and n * len(pages[order[n - 1]]) > CELLS:
                n = max(1, min(n - 1, CELLS // len(pages[order[n - 1]])))
            some, order = order[:n], order[n:]
            x, mask, _ = padded([(pages[k], np.zeros(len(pages[k]))) for k in some])
            logits = self.logits(x, mask)[0]
            for column, k in enumerate(some):
                out[k] = logits[: len(pages[k]), column] > 0
        return out


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(x) for x, _ in pages)
    x = np.zeros((steps, len(pages), WIDTH), np.float32)
    mask, labels = np.zeros((steps, len(pages)), bool), np.full((steps, len(pages)), -1, np.int64)
    for k, (rows, marks) in enumerate(pages):
        x[: len(rows), k], mask[: len(rows), k], labels[: len(rows), k] = rows, True, marks
    return x, mask, labels


def fit_labeller(pages: DataFrame) -> dict[str, np.ndarray]:
    """Weights from TRAIN_PAGES pages, the first by a hash of page_id, of up to 200,000 characters each.

    Two hashes a page find the last that is wanted; only then are whole pages of up to it sent, not the first of every task.
    """
    usable = pages.where(F.col("html").isNotNull() & (F.length("html") <= 200_000))
    hashed = usable.select(F.xxhash64("page_id").alias("h"), F.xxhash64("html").alias("g"), "html")
    first = hashed.select("h", "g").orderBy("h", "g").limit(TRAIN_PAGES).collect()
    if not first:
        return BlockLabeller().w
    h, g = first[-1]
    wanted = hashed.where((F.col("h") < h) | ((F.col("h") == h) & (F.col("g") <= g)))
    some = wanted.orderBy("h", "g").limit(TRAIN_PAGES).collect()
    memo: dict = {}
    cut = [blocks(r["html"]) for r in some]
    labeller = BlockLabeller()
    rng, copies = np.random.default_rng(13), -(-SHAPES // len(cut)) - 2
    shapes: list[tuple[list[Block], list[int]]] = []
    for page in cut:
        marks = [evidence(path) for path, _, _ in page]
        shapes += [(page, marks), (unnamed(page), marks), *(varied(page, marks, rng) for _ in range(copies))]
    labeller.fit([(features(page, memo), np.array(marks)) for page, marks in shapes])
    return labeller.w


def extract_main_text(pages: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; one pass after fitting, no shuffle."""
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit_labeller(pages) if weights is None else weights)
    schema = "page_id long, url string, text string, n_chars long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, memo = BlockLabeller(shared.value), {}
        for batch in portions(batches, TOGETHER):
            cut = [blocks(h.as_py()) for h in batch.column("html")]
            kept = labeller.label([features(page, memo) for page in cut])
            texts = ["\n\n".join(text for (_, text, _), keep in zip(page, marks) if keep) for page, marks in zip(cut, kept)]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(rows, schema)


def op10_html_text(spark, sf_dir):
    from basinflow.llm.common import table

    return extract_main_text(table(spark, sf_dir, "pages"))
