"""Main text of web pages: a chain CRF labels leaf blocks as article or not.

Features are the open elements with their class, id and role names, whole and by stem, and
a few of the text itself. Training pages are a bounded sample of the table, `SAMPLE_PAGES`
by hash of their id, that carry their own labels: blocks inside `article` or `main` and
outside a known side element. Each is also laid out anew `LAYOUTS` times with other
elements and names around its article and with side blocks before, in and after it, whose
labels are known too, so that the model does not rest on one template.

Defined results: NULL and empty pages have no blocks and an empty text; rows that repeat an
id are pages of their own; without any page to learn from, the fixed layouts around a
fixed sentence are the training pages; other columns are ignored.
"""

import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoinlake.llm.carried import carried
from quoinlake.llm.crf import ChainCRF
from quoinlake.llm.dom import Block, blocks

SAMPLE_PAGES, LAYOUTS = 100, 12
# Names of parts of pages in common use.
MAIN_PARTS = (
    "article", "main", "div.content", "div#content", "div.post-content", "div.entry-content", "section.story",
    "div.article-body", "div#main-content", "div.post", "section.article-text", "div.page-content", "div[main]", "section",
    "div.text", "div#story",
)
SIDE_PARTS = (
    "nav", "header", "footer", "aside", "form", "div.nav", "div.navbar", "ul.menu", "div#menu", "div.header",
    "div#header", "div.masthead", "div.footer", "div#footer", "div.sidebar", "div#sidebar", "aside.sidebar",
    "div.notice", "p.notice", "div.cookie-notice", "div.cookie-banner", "div.consent", "div.alert", "div.banner", "div.warning",
    "div.ad", "p.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "aside.ad",
    "div.comments", "section.comments", "div#comments", "div.comment", "ol.comment-list", "div.replies", "section#comments",
    "article.comment", "div.reader-comments", "ul.comments", "form.search", "form.comment-form", "form.newsletter", "div.login",
    "div.newsletter", "div.subscribe", "div.related", "div.share", "div.social", "div.breadcrumbs", "div.widget",
    "div.tags", "div.pagination", "div.copyright", "div.popup", "div.modal", "div[navigation]", "div[complementary]",
    "div[contentinfo]", "div[banner]", "div[alert]", "div.disclaimer", "div.toolbar", "div.meta",
)
MAIN_SHAPES = (
    *["<p>{}</p>"] * 6, "<h2>{}</h2>", "<h3>{}</h3>", "<ul><li>{}</li></ul>", "<ol><li>{}</ol>", "<blockquote>{}</blockquote>",
    "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<div>{}</div>",
    "<figure><figcaption>{}</figcaption></figure>", "<p><a href='/x'>{}</a></p>", "<dl><dd>{}</dl>", "<p><b>{}</b><br></p>",
)
STEMS = (
    "nav", "menu", "side", "foot", "header", "masthead", "notice", "cookie", "consent", "alert", "banner", "warn", "advert",
    "sponsor", "promo", "comment", "repl", "respon", "form", "search", "login", "newsletter", "subscri", "related", "share",
    "social", "crumb", "widget", "tag", "pag", "copyright", "popup", "modal", "disclaim", "toolbar", "meta", "complementary",
    "contentinfo", "discuss", "feedback", "recommend", "sign", "legal", "content", "article", "post", "entry", "story", "text", "body", "main",
)
SIDE_TAGS = frozenset("nav header footer aside form button select fieldset dialog menu".split())
_STEM = re.compile("|".join(STEMS))
_NAME = re.compile(r"[a-z]+")


def path_features(path: tuple[tuple[str, str], ...]) -> list[str]:
    """Features of the open elements of a block, each once."""
    found = {"bias"}
    for tag, names in path:
        if tag not in ("html", "body"):
            found.add(f"in {tag}")
        for name in names.split():
            found.update(f"name {w}" for w in _NAME.findall(name))
            found.update(f"stem {s}" for s in _STEM.findall(name))
            if {"ad", "ads"} & set(_NAME.findall(name)):
                found.add("stem advert")
    if path:
        found.add(f"last {path[-1][0]}")
    return sorted(found)


def text_features(b: Block) -> list[str]:
    n = len(b.text)
    return [
        f"length {min(n.bit_length(), 10)}", f"links {min(3, 4 * b.linked // max(n, 1))}",
        "stop" if b.text[-1] in ".!?…\"'”»" else "no stop", "copyright" if "©" in b.text else "plain",
    ]


def label_by_markup(b: Block) -> int:
    tags = [t for t, _ in b.path]
    names = " ".join(n for _, n in b.path)
    side = SIDE_TAGS & set(tags) or re.search(r"\bads?\b|advert|comment|sidebar|notice|footer|menu|cookie|promo|share|related", names)
    return int(("article" in tags or "main" in tags) and not side)


def _wrapped(part: str, inner: str) -> str:
    tag, kind, name = re.match(r"([a-z]+)([.#\[]?)([^\]]*)", part).groups()
    attribute = {".": f' class="{name}"', "#": f' id="{name}"', "[": f' role="{name}"', "": ""}[kind]
    return f"<{tag}{attribute}>{inner}</{tag}>"


def laid_out(main: list[str], side: list[str], r: random.Random) -> tuple[str, list[int]]:
    """A page around the article's blocks, and the labels of its blocks in order."""
    def aside() -> tuple[str, list[int]]:
        chosen = [r.choice(side if r.random() < 0.5 else main) for _ in range(r.randint(1, 4))]
        tag = r.choice(["p", "p", "li", "div", "a", "span", "h2", "h3", "h4", "blockquote", "td"])
        parts = [f"<{tag}>{x}</{tag}>" + ("<br>" if tag in ("a", "span") else "") for x in chosen]
        part = r.choice(SIDE_PARTS[:5] if r.random() < 0.35 else SIDE_PARTS)
        return _wrapped(part, "".join(parts)), [0] * len(chosen)

    body = []
    for i, x in enumerate(main):
        shape = r.choice(MAIN_SHAPES) if i else r.choice(["<h1>{}</h1>", "<h2>{}</h2>", "<p>{}</p>"])
        body.append((shape.format(x), [1]))
    for _ in range(r.randint(0, 3)):
        body.insert(r.randint(0, len(body)), aside())
    inner, labels = "".join(x for x, _ in body), [y for _, ys in body for y in ys]
    for _ in range(r.randint(0, 2)):
        inner = _wrapped(r.choice(["div", "section", "div.container", "div.wrapper", "div.row"]), inner)
    page = [(_wrapped(r.choice(MAIN_PARTS), inner), labels)]
    for _ in range(r.randint(1, 5)):
        page.insert(r.randint(0, len(page)), aside())
    return "<html><body>" + "".join(x for x, _ in page) + "</body></html>", [y for _, ys in page for y in ys]


def train(pages: list[str]) -> ChainCRF:
    """Fit on labelled pages and on other layouts of them."""
    import html as entities

    r, sequences, truth = random.Random(17), [], []
    for page in pages or ["<article><p>A plain sentence stands here.</p></article><footer>End</footer>"]:
        found = blocks(page)[:40]
        labels = [label_by_markup(b) for b in found]
        main = [entities.escape(b.text) for b, y in zip(found, labels) if y]
        side = [entities.escape(b.text) for b, y in zip(found, labels) if not y] or ["Home", "Contact us", "© all rights"]
        if not main:
            continue
        sequences.append(found)
        truth.append(labels)
        for _ in range(LAYOUTS):
            text, expected = laid_out(main[: r.randint(1, 12)], side, r)
            again = blocks(text)
            if len(again) == len(expected):
                sequences.append(again)
                truth.append(expected)
    features = [[path_features(b.path) + text_features(b) for b in page] for page in sequences]
    return ChainCRF().fit(features, truth)


def sample_pages(pages: DataFrame, key: str, html: str, most: int = SAMPLE_PAGES) -> list[str]:
    """At most `most` pages, those whose ids have the smallest hashes."""
    order = F.xxhash64(key)
    ids = [r[0] for r in pages.where(F.col(key).isNotNull()).select(key).distinct().orderBy(order, key).limit(most).collect()]
    return [r[0] for r in pages.where(F.col(key).isin(ids)).select(html).limit(most).collect() if r[0]] if ids else []


def extract(pages: DataFrame, key: str, html: str, model: ChainCRF, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, text, n_chars) of every page, from its whole HTML."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = shared.value
        paths: dict[tuple, list[float]] = {}
        texts: dict[tuple, list[float]] = {}

        def main_text(page: "str | None") -> str:
            found = blocks(page or "")
            emit = []
            for b in found:
                if b.path not in paths:
                    if len(paths) > 50_000:
                        paths.clear()
                    paths[b.path] = crf.score(path_features(b.path))
                t = tuple(text_features(b))
                if t not in texts:
                    texts[t] = crf.score(t)
                emit.append([x + y for x, y in zip(paths[b.path], texts[t])])
            return " ".join(b.text for b, y in zip(found, crf.decode(emit)) if y)

        for pdf in batches:
            out = pdf.drop(columns="html").assign(text=[main_text(x) for x in pdf["html"].where(pdf["html"].notna(), None)])
            yield out.assign(n_chars=out["text"].map(len).astype("int64"))

    chosen, fields, back = carried(pages.select(key, *keep, F.col(html).alias("html")), [key, *keep])
    return back(chosen.mapInPandas(run, f"{fields}, text string, n_chars long"))


def extraction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, "page_id", "html", train(sample_pages(pages, "page_id", "html")), keep=("url",))
