"""Result trees as a data source: ``spark.read.format("promptloom_results").load(root)``.

Folders below ``root`` are ``[model/]method/task/seed``, plain or as ``column=value``, and become columns. Equality and membership in
these columns are pushed into the source, so files of other cells are never opened; tasks take ``files`` files each
(an option, 256). The driver lists names only.

Defined results, as of ``results.read_results``: a file that is not a JSON object gives a row with ``load_error`` (its first 1,000
characters) and nulls; a test score of 0 is null; missing usage is 0; the seed is the number its folder ends with, else null; an
empty tree gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .storage import ship

FORMAT = "promptloom_results"
CELL = ("model", "method", "task", "seed")
SCHEMA = "model string, method string, task string, seed long, best_score double, test_score double, best_prompt string, calls long, tokens long, load_error string"


def cell_of(below: str, default_model: str) -> tuple[str | None, ...] | None:
    """Model, method, task and seed of a path below the root; None for what is not a result file."""
    *folders, file = [p for p in below.split("/") if p]
    if not re.fullmatch(r"(?:result_|part-).*\.json", file):
        return None
    names = [unquote(re.sub(rf"^(?:{'|'.join(CELL)})=", "", p)) for p in folders]
    model, rest = (names[0], names[1:]) if len(names) >= 4 else (default_model, names)
    method, task, seed = (*rest, None, None, None)[:3]
    digits = re.search(r"([0-9]+)$", seed or "")
    return model, method, task, int(digits[1]) if digits else None


def _file_system(root: str) -> tuple[fs.FileSystem, str]:
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root.removeprefix("file:")


class Files(InputPartition):
    def __init__(self, found: list[tuple[str, tuple]]):
        super().__init__(None)
        self.found = found


class ResultReader(DataSourceReader):
    def __init__(self, root: str, files: int, default_model: str):
        self.root, self.files, self.default_model = root, files, default_model
        self.wanted: dict[int, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what fixes a column of the cell; all other filters stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in CELL:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                at = CELL.index(f.attribute[0])
                self.wanted[at] = self.wanted[at] & values if at in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, base = _file_system(self.root)
        base = base.rstrip("/")
        found = []
        for info in system.get_file_info(fs.FileSelector(base, recursive=True)):
            cell = cell_of(info.path[len(base) :], self.default_model) if info.type == fs.FileType.File else None
            if cell and all(cell[at] is not None and cell[at] in values for at, values in self.wanted.items()):
                found.append((info.path, cell))
        found.sort()
        return [Files(found[i : i + self.files]) for i in range(0, len(found), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _file_system(self.root)
        for path, cell in partition.found:
            with system.open_input_stream(path) as stream:
                text = stream.read().decode("utf-8", "replace")
            yield (*cell, *fields(text))


def fields(text: str) -> tuple:
    """Best score, test score, best prompt, calls, tokens and the error of one file."""
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    whole = lambda v: int(v) if isinstance(v, int) else 0
    try:
        made = json.loads(text)
    except (ValueError, RecursionError):
        made = None
    if not isinstance(made, dict):
        return None, None, None, 0, 0, text[:1000]
    usage = made.get("llm_usage") if isinstance(made.get("llm_usage"), dict) else {}
    prompt = made.get("best_prompt")
    return number(made.get("best_score")), number(made.get("test_score")) or None, prompt if isinstance(prompt, str) else None, whole(usage.get("total_calls")), whole(usage.get("total_tokens")), None


class ResultTree(DataSource):
    """Options: ``path``, ``files`` (files a task) and ``default_model`` (where paths name none)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ResultReader:
        return ResultReader(self.options["path"], int(self.options.get("files", 256)), self.options.get("default_model", "default"))


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach Python sources, which is off unless set."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ResultTree)
