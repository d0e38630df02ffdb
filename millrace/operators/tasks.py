"""Tasks of processing nodes: functions registered by name.

A native task gives Columns for its outputs (and, as `ok`, whether it worked);
it stays inside Spark's generated code. A python task is called for each row of
an Arrow batch with the values of its inputs and returns a value, a tuple or a
dict; what it throws is caught and becomes the record's exception.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.plans.model import DefinitionError

EXCEPTION = "struct<class:string,message:string,stack:string>"


@dataclass(frozen=True)
class Function:
    call: Callable
    outputs: dict[str, str] | None  # of python tasks: output name and type
    native: bool


TASKS: dict[str, Function] = {}


def native_task(name: str):
    """f(params, *columns) -> Column, or dict of output name (and `ok`) to Column."""

    def add(f):
        TASKS[name] = Function(f, None, True)
        return f

    return add


def python_task(name: str, outputs: dict[str, str]):
    """f(params, *values) -> value, tuple or dict of the outputs; False as `ok` marks a failure. Or a class, see above."""

    def add(f):
        TASKS[name] = Function(f, outputs, False)
        return f

    return add


def stack_of(e: BaseException) -> str:
    """Where an exception came from, and its causes, a line each; the record carries it as text."""
    lines, seen = [], set()
    while e is not None and id(e) not in seen:
        seen.add(id(e))
        if lines:
            lines.append(f"Caused by: {type(e).__name__}: {e}")
        at = e.__traceback__
        while at is not None:
            lines.append(f"{at.tb_frame.f_code.co_filename}:{at.tb_lineno} in {at.tb_frame.f_code.co_name}")
            at = at.tb_next
        e = e.__cause__ or (None if e.__suppress_context__ else e.__context__)
    return "\n".join(lines)


def known(name: str) -> Function:
    if name not in TASKS:
        raise DefinitionError(f"no task function {name!r}")
    return TASKS[name]


def called(name: str, params: dict, inputs: list[Column]) -> Column:
    """A python task's result for a record as one struct; it is to be computed once, so it stands as a column of its own."""
    task = known(name)
    kinds, call, names = task.outputs, task.call, list(task.outputs)

    @F.pandas_udf("ok boolean, class string, message string, stack string, " + ", ".join(f"`out_{k}` {t}" for k, t in kinds.items()))
    def run(*cols: pd.Series) -> pd.DataFrame:
        ok, fault, outs = [], [], {k: [] for k in names}
        function = call(params) if isinstance(call, type) else call  # a class is made once a batch
        for values in zip(*cols):
            try:
                if function is not call:
                    got = {"ok": function.runTask(*values)} | {k: getattr(function, "get" + k[:1].upper() + k[1:])() for k in names}
                else:
                    got = function(params, *values)
                if isinstance(got, tuple):
                    got = dict(zip(names, got))
                elif not isinstance(got, dict):
                    got = {names[0]: got} if names else {}
                ok.append(bool(got.get("ok", True)))
                fault.append((None, None, None))
                for k in names:
                    outs[k].append(got.get(k))
            except Exception as e:  # the record carries it on
                ok.append(True)
                fault.append((type(e).__name__, str(e), stack_of(e)))
                for k in names:
                    outs[k].append(None)
        one = lambda i: pd.Series([f[i] for f in fault], dtype=object)
        return pd.DataFrame({"ok": ok, "class": one(0), "message": one(1), "stack": one(2)} | {f"out_{k}": pd.Series(v, dtype=object) for k, v in outs.items()})

    return run.asNondeterministic()(*(inputs or [F.lit(None).cast("string")]))


def run_task(name: str, params: dict, inputs: list[Column], result: Column | None = None) -> tuple[dict[str, Column], Column, Column]:
    """(outputs, ok, exception) of one task; result: of a python task, the column that called() gave."""
    task = known(name)
    if task.native:
        got = task.call(params, *inputs)
        if isinstance(got, Column):
            got = {"value": got}
        ok = got.pop("ok", F.lit(True))
        return got, ok, F.lit(None).cast(EXCEPTION)
    ex = F.when(result["class"].isNotNull(), F.struct(result["class"].alias("class"), result["message"].alias("message"), result["stack"].alias("stack")))
    return {k: result[f"out_{k}"] for k in task.outputs}, result["ok"], ex
