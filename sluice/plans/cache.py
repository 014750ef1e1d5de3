"""Step and row caches in Parquet, keyed by what is computed from what.

A step's key is the canonical text of its call and of its notes, the code of the
Python functions it may call, and a fingerprint of its input: a count and an
order-free sum of row hashes, one aggregate pass. A row's key is the hash of the row
and of the call. Rows that failed are never stored. The store lies in any file system
that driver and executors share. With a step its own fingerprint is stored; a step
whose rows have another one, or a store that can't be read, counts as missing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sluice.lang import ast
from sluice.plans.frame import HIDDEN, Frame
from sluice.runtime import Files, materialize

KEY = f"{HIDDEN}cachekey"


def fingerprint(f: Frame) -> str:
    cols = [F.col(f"`{c}`") for c in f.columns]
    row = F.xxhash64(*[F.to_json(F.struct(c), {"ignoreNullFields": "false"}) for c in cols]) if cols else F.lit(0).cast("bigint")
    got = f.data.select(row.alias("h")).agg(
        F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")
    ).first()
    return hashlib.sha256(repr((f.data.select(*cols).schema.json(), tuple(got))).encode()).hexdigest()


def code_of(call, env) -> str:
    """The Python functions that a call names, as their code, so that another
    function of the same name is another step."""
    out = []
    for name in sorted(ast.free_names(call)):
        try:
            value = env.get(name)
        except KeyError:
            continue
        for fn in [value, *getattr(value, "values", {}).values()] if isinstance(getattr(value, "values", None), dict) else [value]:
            code = getattr(getattr(fn, "fn", fn), "__code__", None)
            if code is not None:
                out.append((name, code.co_code, repr([c for c in code.co_consts if not hasattr(c, "co_code")])))
    return repr(out)


class Store:
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.hits = self.misses = 0

    def _path(self, kind: str, key: str) -> str:
        return f"{self.folder}/{kind}/{key}"

    def _files(self, spark: SparkSession) -> Files:
        return Files(spark, self.folder)

    # -- steps --
    def step_key(self, call, notes, f: Frame, env=None) -> str:
        said = ast.canonical(call) + repr([(n, [ast.canonical(x) for x in a]) for n, a, _ in notes])
        return hashlib.sha256((said + (code_of(call, env) if env is not None else "") + fingerprint(f)).encode()).hexdigest()

    def load_step(self, key: str, like: Frame):
        path = self._path("steps", key)
        spark = like.data.sparkSession
        try:
            facts = json.loads(self._files(spark).read(f"{path}/frame.json"))
            got = Frame(spark.read.parquet(f"{path}/rows"), tuple((c, up) for c, up in facts["order"]), like.errors, dict(like.artifacts), facts["ordered"])
            return got if fingerprint(got) == facts["print"] else None
        except Exception:  # missing or broken: work it out again
            return None

    def save_step(self, key: str, f: Frame) -> Frame:
        """Stored under another name first, so a half-written step is never seen."""
        path, made = self._path("steps", key), self._path("steps", f".{uuid.uuid4().hex}")
        spark = f.data.sparkSession
        files = self._files(spark)
        f.data.write.parquet(f"{made}/rows")
        stored = replace(f, data=spark.read.parquet(f"{made}/rows"))
        files.write(f"{made}/frame.json", json.dumps({"print": fingerprint(stored), "order": f.order, "ordered": f.ordered}))
        if not files.move(made, path):
            files.delete(path)
            files.move(made, path)
        return replace(f, data=spark.read.parquet(f"{path}/rows"))

    # -- rows --
    def rows(self, call, f: Frame, compute, env=None) -> tuple[Frame, int, int]:
        """Run ``compute`` on the rows that aren't stored; (frame, run, cached)."""
        spark = f.data.sparkSession
        files = self._files(spark)
        name = hashlib.sha256((ast.canonical(call) + (code_of(call, env) if env is not None else "")).encode()).hexdigest()
        path = self._path("rows", name)
        f = f.kept()
        cols = [F.col(f"`{c}`") for c in f.columns]
        keyed = f.data.withColumn(KEY, F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256))
        known = None
        if files.exists(path):
            try:
                known = spark.read.parquet(path)
                known.schema[KEY]
            except Exception:
                files.delete(path)
                known = None
        fresh = keyed if known is None else keyed.join(known.select(KEY), KEY, "left_anti")
        fresh = materialize(fresh)  # what is missing now: the store is about to grow
        run = fresh.count()
        done = compute(replace(f, data=fresh))
        visible = [c for c in done.columns]
        picked = [F.col(KEY), *[F.col(f"`{c}`") for c in visible]]
        done.data.select(*picked).dropDuplicates([KEY]).write.mode("append").parquet(path)
        store = spark.read.parquet(path).select(*picked).dropDuplicates([KEY])
        renamed = store.select(F.col(KEY), *[F.col(f"`{c}`").alias(f"{HIDDEN}c{i}") for i, c in enumerate(visible)])
        back = keyed.select(KEY, *[F.col(f"`{c}`") for c in f.secret]).join(renamed, KEY)
        data = back.select(*[F.col(f"{HIDDEN}c{i}").alias(c) for i, c in enumerate(visible)], *[F.col(f"`{c}`") for c in f.secret])
        total = keyed.count()
        return replace(done, data=data, order=f.order), run, total - run

