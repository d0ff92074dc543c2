"""Named workflows with several inputs and outputs.

``run`` computes what several outputs share once, runs independent outputs at the same time and publishes all
outputs or none: all are written to one staging folder. Where the target doesn't exist yet this folder is renamed as a
whole; else its outputs are renamed one by one, and those already renamed are taken back if one fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..sources import sinks
from .pipeline import Pipeline


def ancestry(bag) -> Iterator:
    """The bag and all that it derives from, each once."""
    seen: set[int] = set()
    todo = [bag]
    while todo:
        b = todo.pop()
        if id(b) not in seen:
            seen.add(id(b))
            yield b
            todo.extend(b.parents)


def shared_parents(outputs: list) -> list:
    """Bags worth keeping: expensive ones that two consumers or more need."""
    nodes = {id(b): b for out in outputs for b in ancestry(out)}
    uses: dict[int, int] = dict.fromkeys(nodes, 0)
    for b in nodes.values():
        for p in b.parents:
            uses[id(p)] += 1
    for out in outputs:
        uses[id(out)] += 1
    return [b for k, b in nodes.items() if uses[k] > 1 and b.opaque]


def publish(fs, at, staging: str, path: str, names: list[str]) -> None:
    """Moves all folders of ``staging`` to ``path``, or none."""
    if not fs.exists(at(path)):
        if not fs.rename(at(staging), at(path)):
            raise OSError(f"{path} could not be renamed")
        return
    done: list[str] = []
    try:
        for n in names:
            if not fs.rename(at(f"{staging}/{n}"), at(f"{path}/{n}")):
                raise OSError(f"{n} could not be renamed")
            done.append(n)
    except BaseException:
        for n in done:
            fs.rename(at(f"{path}/{n}"), at(f"{staging}/{n}"))
        raise


class Workflow:
    """Subclass it and give ``build``, which calls ``input`` and ``output``."""

    def __init__(self, spark: SparkSession):
        self.pipeline = Pipeline(spark)
        self.inputs: dict[str, object] = {}
        self.outputs: dict[str, object] = {}
        self._built = False

    @property
    def name(self) -> str:
        return type(self).__name__

    def build(self) -> None:
        raise NotImplementedError

    def input(self, name: str, bag):
        if name in self.inputs:
            raise ValueError(f"two inputs are named {name}")
        self.inputs[name] = bag
        return bag

    def output(self, name: str, bag):
        if name in self.outputs:
            raise ValueError(f"two outputs are named {name}")
        self.outputs[name] = bag
        return bag

    def built(self) -> Workflow:
        if not self._built:
            self.build()
            if not self.inputs:
                raise ValueError(f"{self.name} has no input")
            if not self.outputs:
                raise ValueError(f"{self.name} has no output")
            self._built = True
        return self

    def frames(self) -> dict[str, DataFrame]:
        return {k: b.df for k, b in self.built().outputs.items()}

    def collect(self) -> dict[str, list]:
        return {k: b.collect() for k, b in self.built().outputs.items()}

    def run(self, path: str, writer=sinks.parquet, parallel: int = 4) -> dict[str, str]:
        """Writes every output to ``path/<name>``; returns the folders."""
        self.built()
        spark = self.pipeline.spark
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        fs = at(path).getFileSystem(conf)
        taken = [n for n in self.outputs if fs.exists(at(f"{path}/{n}"))]
        if taken:
            raise FileExistsError(f"{path} already has {taken}")
        path = path.rstrip("/")
        staging = f"{path}-staging-{uuid.uuid4().hex}"
        kept = shared_parents(list(self.outputs.values()))
        for b in kept:
            b.df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            with ThreadPoolExecutor(parallel) as pool:
                for job in [pool.submit(writer, b, f"{staging}/{n}") for n, b in self.outputs.items()]:
                    job.result()
            publish(fs, at, staging, path, list(self.outputs))
        finally:
            for b in kept:
                b.df.unpersist()
            fs.delete(at(staging), True)
        return {n: f"{path}/{n}" for n in self.outputs}
