"""Captions of images: made by a model that the caller brings or a server that answers as chat completions, and put on the blocks of fragments."""

from __future__ import annotations

import base64
import importlib
import json
import urllib.request
from collections.abc import Callable, Hashable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.schema import BLOCK

KEY = ["doc_id", "page_number"]
CAPTION = "doc_id long, page_number int, image_no int, caption string"
#: Images that a model sees at once.
AT_ONCE = 16
Model = Callable[[list[bytes]], list[str | None]]
#: The shortest side of an image worth a caption, a reply's most tokens and its temperature, seconds for a reply and for the list of models.
LEAST_SIDE, TOKENS, TEMPERATURE, REPLY_SECONDS, LIST_SECONDS = 32, 60, 0.2, 120, 5
PROMPT = "Say in one short sentence what the picture shows, as an alternative text for a web page. Give the sentence alone."
_MODELS: dict[Hashable, Model] = {}


def once_a_process(key: Hashable, load: Callable[[], Model]) -> Callable[[], Model]:
    """load, as caption_images() takes it, but called once for a worker process and key, however many tasks it runs."""

    def get() -> Model:
        kept = importlib.import_module(__name__)._MODELS  # the worker's own: a function that is sent there brings copies of what it names
        if key not in kept:
            kept[key] = load()
        return kept[key]

    return get


def png_sides(content: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG, by its first chunk; null of what is none."""
    if len(content) < 24 or not content.startswith(b"\x89PNG\r\n\x1a\n"):
        return None
    return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")


@dataclass(frozen=True)
class Server:
    """A server of chat completions that reads images. An instance is a model: images that are no PNG or too small, and those it fails on, have no caption."""

    url: str
    model: str

    def _ask(self, path: str, body: dict | None, seconds: float) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(f"{self.url.rstrip('/')}/{path}", data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return json.load(answer)

    def check(self) -> None:
        """An error that says what is wrong, before any image is sent: no server, no model named, or one that the server doesn't list."""
        try:
            listed = [m.get("id") for m in self._ask("models", None, LIST_SECONDS).get("data", [])]
        except (OSError, ValueError) as e:
            raise ConnectionError(f"no caption server answers at {self.url}: {e}") from e
        if not self.model or (listed and self.model not in listed):
            raise ValueError(f"the caption server at {self.url} has no model {self.model!r}; it lists: {', '.join(map(str, listed)) or 'none'}")

    def _one(self, content: bytes) -> str | None:
        sides = png_sides(content)
        if sides is None or min(sides) < LEAST_SIDE:
            return None
        image = {"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(content).decode()}}
        body = {"model": self.model, "max_tokens": TOKENS, "temperature": TEMPERATURE, "messages": [{"role": "user", "content": [{"type": "text", "text": PROMPT}, image]}]}
        try:
            return self._ask("chat/completions", body, REPLY_SECONDS)["choices"][0]["message"]["content"].strip() or None
        except (OSError, ValueError, LookupError, AttributeError, TypeError):
            return None

    def __call__(self, contents: list[bytes]) -> list[str | None]:
        with ThreadPoolExecutor(len(contents) or 1) as pool:
            return list(pool.map(self._one, contents))


def caption_images(images: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """CAPTION of images (doc_id, page_number, image_no, content binary).

    load() is called once for a task and gives the model, which takes images' bytes and gives as many captions. Null and empty images have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                model = model or load()
                captions = model(part.column("content").to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in range(3)], pa.array(captions, pa.string())], [c.split()[0] for c in CAPTION.split(", ")])

    own = images.where("length(content) > 0")
    return own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_number").cast("int").alias("page_number"), F.col("image_no").cast("int").alias("image_no"), "content").mapInArrow(run, CAPTION)


def with_captions(fragments: DataFrame, captions: DataFrame) -> DataFrame:
    """fragments with captions (CAPTION) on their images, by an image's place among those of its page, from 1: as an image's alternative text, or a placeholder's caption.

    Of several captions of an image the greatest counts; images without one stay as they are.
    """
    known = captions.where("caption <> ''").groupBy(*KEY, "image_no").agg(F.max("caption").alias("caption"))
    known = known.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("image_no", "caption"))).alias("_captions"))
    names = [f.split(":")[0] for f in ("type", "text", "level", "ordered", "runs", "rows", "src", "alt", "caption", "column", "indent_em")]

    def own(b: Column, number: Column) -> Column:
        found = F.try_element_at("_captions", number)
        put = {"alt": F.when(b["type"] == "img", F.coalesce(found, b["alt"])).otherwise(b["alt"]), "caption": F.when(b["type"] == "img_placeholder", F.coalesce(found, b["caption"])).otherwise(b["caption"])}
        return F.struct(*[put.get(n, b[n]).alias(n) for n in names]).cast(BLOCK)

    image = lambda b: b["type"].isin("img", "img_placeholder")
    counts = F.aggregate("blocks", F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + F.when(image(b), 1).otherwise(0))))
    d = fragments.join(known, KEY, "left").withColumn("_numbers", counts)
    blocks = F.transform("blocks", lambda b, i: own(b, F.get(F.col("_numbers"), i) + 1))
    return d.withColumn("blocks", F.when(F.col("_captions").isNull(), F.col("blocks")).otherwise(blocks)).select(*fragments.columns)
