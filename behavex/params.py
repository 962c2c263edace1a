"""Task parameters: a JSON object whose values are arrays of which the first element counts."""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class TaskParams:
    """What a job can be asked for. None leaves a filter out; lists come from comma-separated text."""

    startdate: str | None = None
    enddate: str | None = None
    startage: int | None = None
    endage: int | None = None
    professional: list[str] | None = None
    city: list[str] | None = None
    sex: str | None = None
    keywords: list[str] | None = None
    categoryIds: list[str] | None = None
    targetpageflow: list[int] | None = None

    @classmethod
    def parse(cls, text: str | None) -> TaskParams:
        """Reads task JSON. Unknown keys are ignored; an absent, empty or null value is no parameter."""
        if text is None:
            raise ValueError("the task has no parameters")
        given = json.loads(text)

        def first(name: str):
            value = given.get(name)
            value = value[0] if isinstance(value, list) and value else None
            return None if value is None or value == "" else str(value)

        raw = {f.name: first(f.name) for f in fields(cls)}
        for name in ("startage", "endage"):
            raw[name] = int(raw[name]) if raw[name] is not None else None
        for name in ("professional", "city", "keywords", "categoryIds"):
            raw[name] = raw[name].split(",") if raw[name] is not None else None
        if raw["targetpageflow"] is not None:
            raw["targetpageflow"] = [int(x) for x in raw["targetpageflow"].split(",")]
        return cls(**raw)


def task_arguments(args: list[str], default_task: int | None = None) -> int:
    """The task id of a job's command line."""
    parser = argparse.ArgumentParser()
    parser.add_argument("task_id", nargs="?", type=int, default=default_task)
    task = parser.parse_args(args).task_id
    if task is None:
        raise ValueError("no task id given")
    return task


class Settings:
    """Typed access to string properties: a number that can't be read is 0, any other text than true is False."""

    def __init__(self, values: dict[str, str]):
        self.values = values

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path, encoding="utf-8") as f:
            lines = (x.strip() for x in f)
            return cls({k.strip(): v.strip() for k, _, v in (x.partition("=") for x in lines if x and x[0] not in "#!")})

    def text(self, key: str) -> str | None:
        return self.values.get(key)

    def integer(self, key: str) -> int:
        try:
            return int(self.values.get(key, ""))
        except ValueError:
            return 0

    def flag(self, key: str) -> bool:
        return self.values.get(key, "").lower() == "true"
