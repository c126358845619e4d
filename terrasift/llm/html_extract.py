"""Main text of web pages by a recurrent labeller of text blocks.

A page is read into its leaf blocks in page order. A block is seen as its tag path (hashed
tags and class words), its hashed words and a few measures. A bidirectional LSTM, forward and
backward in plain numpy, runs over the whole sequence, so each block is labelled in the
context of its document; blocks labelled as main text are joined.

The network is trained here on a bounded sample of the pages, at most ``SAMPLE`` pages chosen by
a hash of the id. Silver labels come from the sectioning
of those pages; boilerplate of kinds that a sample may lack (comment threads, notices, forms,
share bars, nested menus) is woven in from fixed lists of tags and class words, and section
marks are taken away in part of the copies so that the context has to be learnt.

Defined cases: null or empty html gives an empty text; text outside any tag is a block like
others; unclosed tags, comments and scripts end where a browser would end them or with the
page; formulas, drawings, embedded objects and what stands in for them are elements whose texts
the labeller sees like others; repeated rows get equal texts; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 256
PATH_SLOTS, WORD_SLOTS, MEASURES, HIDDEN = 512, 16, 5, 16
EPOCHS, BATCH, RATE, SEED = 9, 32, 0.02, 41
#: Block steps, with padding, that a task labels at once.
STEPS = 60_000

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr img br "
    # formulas, drawings and embedded content stand in the line
    "math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mstyle mover munder munderover semantics annotation "
    "svg g text tspan path rect circle line canvas object iframe".split()
)
#: Opening one of these ends an open element named on the right, unless one of the bounds lies between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "body": (("head",), ()),
}
# Names that mark sections, for the silver labels and the woven examples.
MAIN_TAGS = ("article", "main")
MAIN_WORDS = ("article", "content", "post", "entry", "story", "main")
SIDE_TAGS = ("nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "figcaption")
SIDE_WORDS = (
    "nav", "navigation", "menu", "header", "footer", "sidebar", "ad", "ads", "advert", "advertisement", "promo",
    "sponsor", "sponsored", "banner", "cookie", "consent", "notice", "popup", "modal", "newsletter", "subscribe",
    "form", "search", "login", "share", "social", "related", "recommended", "comment", "comments", "reply", "replies",
    "breadcrumb", "pagination", "widget", "copyright", "legal", "toolbar", "masthead", "alert",
)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>",
    re.S,
)
MARKS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    link_share: float


@dataclass
class Reader:
    """Reads a page into blocks; one open block at a time."""

    stack: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    held: list[str] = field(default_factory=list)
    path: tuple[str, ...] = ()
    linked: int = 0

    def text(self, piece: str) -> None:
        if not self.held or not self.path:
            if not piece.isspace():
                self.path = tuple(t for _, tokens in self.stack for t in tokens) or ("t:",)
        self.held.append(html.unescape(piece) if "&" in piece else piece)
        if any(tag == "a" for tag, _ in self.stack):
            self.linked += len(piece)

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.blocks.append(Block(self.path or ("t:",), text, min(1.0, self.linked / len(text))))
        self.held, self.path, self.linked = [], (), 0

    def open(self, tag: str, marks: str) -> None:
        if tag == "br":
            self.held.append("\n")
            return
        if tag not in INLINE:
            self.flush()
            targets, bounds = ENDS.get(tag, (("p",), ("table", "button", "object")))
            self.end(targets, bounds)
        if tag in VOID:
            return
        tokens = [f"t:{tag}"]
        if marks and not marks.isspace():
            for name, *values in MARKS.findall(marks):
                value = next((v for v in values if v), "").lower()
                if name.lower() in ("class", "id", "role"):
                    tokens += [f"c:{w}" for w in WORDS.findall(value)]
                elif "style" not in name.lower() and value != "false" or "display:none" in value.replace(" ", ""):
                    tokens.append("hidden")
        self.stack.append((tag, tuple(tokens)))

    def end(self, targets: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        """Close up to the outermost target above the nearest bound, if there is one."""
        at = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in targets:
                at = i
            elif self.stack[i][0] in bounds:
                break
        if at is not None:
            del self.stack[at:]

    def close(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return


def read_blocks(page: str | None) -> list[Block]:
    page, reader, at = page or "", Reader(), 0
    while True:
        found = TAG.search(page, at)
        if not found:
            break
        if found.start() > at:
            reader.text(page[at:found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            reader.close(tag)
            continue
        marks = found[3] or found[6] or ""
        if tag in RAW:
            if not marks.endswith("/"):
                ended = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = ended.end() if ended else len(page)
            continue
        reader.open(tag, marks)
    if at < len(page):
        reader.text(page[at:])
    reader.flush()
    return reader.blocks


def silver(path: tuple[str, ...], link_share: float) -> int | None:
    """1 for main text, 0 for the rest by section marks; None where no mark decides."""
    main, tag = False, ""
    for token in path:
        kind, _, name = token.partition(":")
        if kind == "t":
            tag = name
            if name in SIDE_TAGS:
                return 0
            main |= name in MAIN_TAGS
        elif kind == "hidden":
            return 0
        elif tag not in ("html", "body", *MAIN_TAGS) and name in SIDE_WORDS:
            return 0
        else:
            main |= name in MAIN_WORDS
    if main:
        return 1
    return 0 if "t:header" in path or link_share > 0.5 else None


def woven(blocks: list[Block], labels: list[int], others: list[str], chance: random.Random) -> tuple[list[Block], list[int]]:
    """A copy of a page with boilerplate of random kinds put in and some section marks renamed."""
    rename = chance.choice((None, None, "t:main", "c:content", "c:post", "c:entry", "c:story"))
    out, marks = [], []

    def extra(base: tuple[str, ...]) -> None:
        tag = chance.choice(("div", "div", "section", "ul", "aside", "form", "nav", "header", "footer"))
        word = chance.choice(SIDE_WORDS) if tag in ("div", "section", "ul") or chance.random() < 0.5 else None
        if tag == "header" and any(t in base for t in ("t:article", "t:main")) and not word:
            word = chance.choice(SIDE_WORDS)
        inner = chance.choice((("t:p",), ("t:li",), ("t:div",), ("t:p", "t:b"), ("t:h3",), ("t:label",), ()))
        for _ in range(chance.choice((1, 1, 2, 4))):
            linked = chance.choice((0.0, 0.0, 1.0))
            out.append(Block(base + (f"t:{tag}",) + ((f"c:{word}",) if word else ()) + inner, chance.choice(others), linked))
            marks.append(0)

    for block, label in zip(blocks, labels):
        path = block.path
        if rename:
            path = tuple(("t:div" if rename.startswith("c:") else rename) if t == "t:article" else t for t in path)
            if rename.startswith("c:") and "t:article" in block.path:
                at = path.index("t:div", block.path.index("t:article"))
                path = path[: at + 1] + (rename,) + path[at + 1:]
        if chance.random() < 0.12:
            # Beside the block: under its page, or inside its article as threads and adverts are.
            base = path[:-1] if label and chance.random() < 0.6 else tuple(t for t in path[:2])
            extra(base)
        out.append(Block(path, block.text, block.link_share))
        marks.append(label)
    return out, marks


def slot(token: str, slots: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % slots


def path_slots(path: tuple[str, ...]) -> np.ndarray:
    """Slots of a path: its tokens, and the last three with their depth from the leaf."""
    near = [f"{i}{t}" for i, t in enumerate(path[:-4:-1])]
    return np.unique([slot(t, PATH_SLOTS) for t in (*path, *near)])


def measures(blocks: list[Block]) -> np.ndarray:
    """Hashed words and measures of each block, rows x (WORD_SLOTS + MEASURES)."""
    out = np.zeros((len(blocks), WORD_SLOTS + MEASURES))
    for i, block in enumerate(blocks):
        words = block.text.lower().encode("utf-8", "surrogatepass").split()
        hashed = np.bincount([zlib.crc32(w) % WORD_SLOTS for w in words], minlength=WORD_SLOTS) / len(words)
        out[i, :WORD_SLOTS] = hashed
        out[i, WORD_SLOTS:] = (
            np.log1p(len(words)) / 5, block.link_share, (i + 1) / len(blocks),
            sum(map(block.text.count, ".,;:!?")) / (1 + len(words)), block.text[-1:] in ".!?",
        )
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Labeller:
    """Bidirectional LSTM over blocks with a logistic output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        width = 4 * HIDDEN

        def some(*shape: int) -> np.ndarray:
            return rng.standard_normal(shape) * 0.15

        self.weights = {"out": some(2 * HIDDEN), "bias": np.zeros(1)}
        for side in "fb":
            self.weights |= {
                f"path{side}": some(PATH_SLOTS, width), f"word{side}": some(WORD_SLOTS + MEASURES, width),
                f"back{side}": some(HIDDEN, width), f"gate{side}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN),
            }

    def run(self, paths: np.ndarray, words: np.ndarray, mask: np.ndarray, unique: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits (pages x steps). paths: rows of ``unique`` (multi-hot); keeps what training needs."""
        pages, steps = mask.shape
        w, kept, states = self.weights, {}, []
        for side in "fb":
            drive = (unique @ w[f"path{side}"])[paths] + words @ w[f"word{side}"] + w[f"gate{side}"]
            h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
            hs, saved = np.zeros((pages, steps, HIDDEN)), []
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                z = drive[:, t] + h @ w[f"back{side}"]
                gates = sigmoid(z[:, : 3 * HIDDEN])
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN: 2 * HIDDEN], gates[:, 2 * HIDDEN:]
                g = np.tanh(z[:, 3 * HIDDEN:])
                live = mask[:, t, None]
                new = f * c + i * g
                tanh = np.tanh(new)
                saved.append((t, i, f, o, g, c, h, tanh, live))
                c, h = np.where(live, new, c), np.where(live, o * tanh, h)
                hs[:, t] = h
            states.append(hs)
            kept[side] = saved
        both = np.concatenate(states, axis=2)
        return both @ w["out"] + w["bias"], {"saved": kept, "both": both, "paths": paths, "words": words, "unique": unique}

    def gradients(self, error: np.ndarray, kept: dict) -> dict[str, np.ndarray]:
        """Backpropagation through both directions; ``error`` is the loss slope of each logit."""
        w, both = self.weights, kept["both"]
        out = {"out": np.einsum("pt,ptk->k", error, both), "bias": np.array([error.sum()])}
        upper = error[:, :, None] * w["out"]
        for k, side in enumerate("fb"):
            above = upper[:, :, k * HIDDEN:(k + 1) * HIDDEN]
            dz_all = np.zeros((*error.shape, 4 * HIDDEN))
            back = np.zeros_like(w[f"back{side}"])
            dh, dc = np.zeros((len(error), HIDDEN)), np.zeros((len(error), HIDDEN))
            for t, i, f, o, g, c, h, tanh, live in reversed(kept["saved"][side]):
                dh_t = above[:, t] + dh
                d_new = np.where(live, dc + dh_t * o * (1 - tanh**2), 0.0)
                dz = np.concatenate([
                    d_new * g * i * (1 - i), d_new * c * f * (1 - f), np.where(live, dh_t * tanh, 0.0) * o * (1 - o), d_new * i * (1 - g**2)
                ], axis=1)
                dz_all[:, t] = dz
                back += h.T @ dz
                dh = np.where(live, dz @ w[f"back{side}"].T, dh_t)
                dc = np.where(live, d_new * f, dc)
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            by_path = np.zeros((len(kept["unique"]), 4 * HIDDEN))
            np.add.at(by_path, kept["paths"].reshape(-1), flat)
            out |= {
                f"path{side}": kept["unique"].T @ by_path, f"back{side}": back, f"gate{side}": flat.sum(0),
                f"word{side}": kept["words"].reshape(-1, WORD_SLOTS + MEASURES).T @ flat,
            }
        return out

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
        """Adam over mini-batches of pages."""
        chance, step = random.Random(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        order = list(range(len(pages)))
        for epoch in range(epochs):
            chance.shuffle(order)
            for at in range(0, len(order), BATCH):
                chosen = [pages[i] for i in order[at:at + BATCH]]
                paths, words, mask, unique = arranged([b for b, _ in chosen])
                truth = np.zeros(mask.shape)
                for row, (_, labels) in zip(truth, chosen):
                    row[: len(labels)] = labels
                logits, kept = self.run(paths, words, mask, unique)
                slopes = self.gradients(np.where(mask, sigmoid(logits) - truth, 0.0) / mask.sum(), kept)
                size = np.sqrt(sum(float((g**2).sum()) for g in slopes.values()))
                step += 1
                rate = RATE * (1 - epoch / epochs) * min(1.0, 1.0 / max(size, 1e-12))
                for name, slope in slopes.items():
                    first[name] += 0.1 * (slope - first[name])
                    second[name] += 0.001 * (slope**2 - second[name])
                    adapted = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    self.weights[name] -= rate * adapted
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length run together."""
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        group: list[int] = []
        for place, i in enumerate(order):
            if pages[i]:
                group.append(i)
            last = place + 1 == len(order)
            if group and (last or (len(group) + 1) * len(pages[order[place + 1]]) > STEPS):
                logits, _ = self.run(*arranged([pages[j] for j in group]))
                for j, row in zip(group, logits):
                    out[j] = row[: len(pages[j])] > 0
                group = []
        return out


def arranged(pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(paths, words, mask, unique) of pages padded to the longest."""
    steps = max(map(len, pages))
    paths = np.zeros((len(pages), steps), np.int64)
    words = np.zeros((len(pages), steps, WORD_SLOTS + MEASURES))
    mask = np.zeros((len(pages), steps), bool)
    known: dict[tuple[str, ...], int] = {}
    for p, blocks in enumerate(pages):
        paths[p, : len(blocks)] = [known.setdefault(b.path, len(known)) for b in blocks]
        words[p, : len(blocks)] = measures(blocks)
        mask[p, : len(blocks)] = True
    unique = np.zeros((max(1, len(known)), PATH_SLOTS))
    for path, k in known.items():
        unique[k, path_slots(path)] = 1.0
    return paths, words, mask, unique


def examples(pages: list[str], seed: int = SEED) -> list[tuple[list[Block], list[int]]]:
    """Silver-labelled pages, as read and in woven copies; pages without a section mark are left out."""
    chance, read, out = random.Random(seed), [], []
    for page in pages:
        blocks = read_blocks(page)
        labels = [silver(b.path, b.link_share) for b in blocks]
        if blocks and 1 in labels:
            read.append((blocks, [x or 0 for x in labels]))
    others = [b.text for blocks, labels in read for b, x in zip(blocks, labels) if not x] or ["Menu"]
    others += [" ".join(b.text.split()[:20]) for blocks, labels in read for b, x in zip(blocks, labels) if x][:200]
    for blocks, labels in read:
        out.append((blocks, labels))
        out += [woven(blocks, labels, others, chance) for _ in range(2)]
    return out


def train(pages: DataFrame, size: int = SAMPLE) -> Labeller:
    share = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "page_id"), 11) / F.lit(float(1 << 53))
    total = pages.count()
    rows = (
        pages.filter(F.col("html").isNotNull()).withColumn("_u", share)
        .filter(F.col("_u") * total <= 2.0 * size + 20).select("_u", "html").orderBy("_u", "html").limit(size).collect()
    )
    return Labeller().fit(examples([r["html"] for r in rows]))


def main_text(blocks: list[Block], wanted: np.ndarray) -> str:
    return "\n".join(b.text for b, keep in zip(blocks, wanted) if keep)


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, n_blocks."""
    model = train(pages) if labeller is None else labeller

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                read = [read_blocks(x.as_py()) for x in rows.column("html")]
                texts = [main_text(b, keep) for b, keep in zip(read, model.label(read))]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in read], pa.int64())],
                    ["page_id", "url", "text", "n_chars", "n_blocks"],
                )

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(
        code, f"page_id {kind}, url string, text string, n_chars long, n_blocks long"
    )
