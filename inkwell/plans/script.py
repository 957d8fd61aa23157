"""One surface over both parsers and all that is made of their elements."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from inkwell.operators import fast, html, legacy, paginate, title_page, writer
from inkwell.operators.describe import described
from inkwell.sources.scripts import read_scripts, scripts_from_strings, write_documents

PARSERS = ("fast", "regex")


@dataclass(frozen=True)
class Corpus:
    """Scripts (script_id, filename, text) and what they parse to; nothing runs until a result is asked for.

    Elements that go to more than one consumer may be persisted by the caller; every method plans from them."""

    scripts: DataFrame
    parser: str = "fast"
    suppress_scene_numbers: bool = False

    def __post_init__(self):
        if self.parser not in PARSERS:
            raise ValueError(f"parser must be one of {PARSERS}")

    @classmethod
    def load_file(cls, spark: SparkSession, path: str | list[str], parser: str = "fast") -> Corpus:
        return cls(read_scripts(spark, path), parser)

    @classmethod
    def load_string(cls, spark: SparkSession, text: str, parser: str = "fast") -> Corpus:
        return cls(scripts_from_strings(spark, [text]), parser)

    @cached_property
    def elements(self) -> DataFrame:
        return (fast if self.parser == "fast" else legacy).elements(self.scripts)

    @cached_property
    def title_page(self) -> DataFrame:
        return (title_page if self.parser == "fast" else legacy).title_page(self.scripts)

    def string_from_document(self) -> DataFrame:
        return writer.documents(self.elements, self.title_page, self.suppress_scene_numbers)

    def string_from_body(self) -> DataFrame:
        return writer.bodies(self.elements, self.suppress_scene_numbers)

    def string_from_title_page(self) -> DataFrame:
        return writer.title_texts(self.title_page)

    def description(self) -> DataFrame:
        return described(self.elements)

    def pages(self, size: tuple[int, int] = paginate.LETTER) -> DataFrame:
        return paginate.paginate(self.elements, size)

    def html(self, css: str = html.DEFAULT_CSS, size: tuple[int, int] = paginate.LETTER, escape: bool = False) -> DataFrame:
        return html.html(self.elements, self.title_page, css, size, escape)

    def write(self, path: str, mode: str = "errorifexists") -> None:
        write_documents(self.string_from_document(), path, mode)
