"""The one place that says which files make up a table.

A table that changes writes its new files next to the old ones, then a new manifest, and deletes last. Manifests are
small numbered files; the highest number counts. A manifest appears as a whole or not at all and never replaces
another, so whenever a job dies, readers have the table before it or the table after it, and of two jobs that change
a table at once the second one fails instead of undoing the first.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

from strandline.files import child_names, delete_folder, put_new, read_text

SUFFIX = ".json"
KEPT = 2  # the newest, and the one that readers may still be at


class Manifest:
    """Numbered manifests in one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def numbers(self) -> list[int]:
        names = child_names(self.spark, self.folder)
        return sorted(int(n.removesuffix(SUFFIX)) for n in names if n.endswith(SUFFIX) and not n.startswith("."))

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:012}{SUFFIX}"

    def newest(self) -> tuple[int, dict[str, Any] | None]:
        """Number and content of the manifest that counts; 0 and None where there is none."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, None)

    def read(self, number: int) -> dict[str, Any]:
        return json.loads(read_text(self.spark, self._path(number)))

    def switch(self, after: int, content: dict[str, Any]) -> None:
        """Make ``content`` the one that counts, if manifest ``after`` still is."""
        put_new(self.spark, self._path(after + 1), json.dumps(content))

    def forget(self) -> list[dict[str, Any]]:
        """Delete all manifests but the newest few, and return those; what none of them names can go."""
        numbers = self.numbers()
        for number in numbers[:-KEPT]:
            delete_folder(self.spark, self._path(number))
        return [self.read(number) for number in numbers[-KEPT:]]
