"""Checks on each micro-batch of a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.analyzers import Analyzer
from ..operators.check import Check
from ..operators.verification import VerificationResult, VerificationSuite
from ..plans.runner import AnalysisRunner, AnalyzerContext
from ..plans.states import States, StateStore
from ..sources.repository import MetricsRepository, ResultKey


def monitor(stream: DataFrame, checks: Iterable[Check], repository: MetricsRepository | None = None,
            on_result: Callable[[int, VerificationResult], None] | None = None, tags: dict[str, str] | None = None) -> DataStreamWriter:
    """A stream writer that verifies every micro-batch; its results are kept under the batch's number.

    A batch that is repeated after a failure replaces its own metrics, so the history has each once.
    """
    checks = list(checks)

    def verify(batch: DataFrame, number: int) -> None:
        run = VerificationSuite(batch.sparkSession).onData(batch)
        for check in checks:
            run = run.addCheck(check)
        if repository is not None:
            run = run.useRepository(repository).saveOrAppendResult(ResultKey(number, dict(tags or {})))
        result = run.run()
        if on_result is not None:
            on_result(number, result)

    return stream.writeStream.foreachBatch(verify)


def running_metrics(stream: DataFrame, analyzers: Iterable[Analyzer], store: StateStore,
                    on_result: Callable[[int, AnalyzerContext], None] | None = None, repository: MetricsRepository | None = None) -> DataStreamWriter:
    """A stream writer that keeps metrics of all rows so far; each batch reads its own rows and the states of the total before it.

    The total up to a batch is saved under the batch's number, from the newest total of a smaller number. A batch that is repeated after a
    failure thus begins from the same total as before, and counts once. The last two totals are kept.
    """
    analyzers = list(analyzers)

    def add(batch: DataFrame, number: int) -> None:
        own = States.of(batch, analyzers)
        earlier = sorted(int(p) for p in store.parts() if int(p) < number)
        before = [store.load(str(earlier[-1]), analyzers)] if earlier else []
        store.save(str(number), States.merge([*before, own]))
        total = store.load(str(number), analyzers)
        total.problems |= own.problems
        context = AnalysisRunner.onStates(total, analyzers)
        if repository is not None:
            repository.save(ResultKey(number), context)
        for old in earlier[:-1]:
            store.drop(str(old))
        if on_result is not None:
            on_result(number, context)

    return stream.writeStream.foreachBatch(add)
