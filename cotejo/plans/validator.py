"""The ticket validator: every rule set over prepared inputs.

One lazy plan: reconcile, evaluate each rule set in one pass, union the
findings, group them by ticket.  Data and voice documents go through the same
joins, told apart by their component.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.operators.findings import MISSING, by_ticket, union_all
from cotejo.operators.intervals import with_stops
from cotejo.operators.joins import PAIRED, enrich, mark_join, matched, only_left, repeated, unique, unique_beside
from cotejo.operators.rules import Rule, evaluate
from cotejo.plans.cut_rules import (
    CLAIM,
    DATA,
    VOICE,
    cut_rules,
    missing_incident,
    with_block,
    with_rule_columns,
)
from cotejo.plans.inputs import Late
from cotejo.plans.word_rules import (
    NOT_FOUND,
    annex_fields,
    claim_not_in_faults,
    claim_not_in_reports,
    fault_fields,
    report_fields,
)

KEY = "nro_incidencia"
#: Whether the incident extract has a cut row's ticket.
FOUND = "inc_found"


@dataclass(frozen=True)
class Inputs:
    """Prepared frames (``plans.inputs``).

    The word frames hold both documents, labelled by component; leave one out
    where no such document exists.  ``unique`` names frames that must have each ticket
    (circuits: each circuit; word frames: each ticket of a component) once; a repeated one raises when rows are made.
    """

    cut: DataFrame | Late
    incidents: DataFrame | Late
    stops: DataFrame
    circuits: DataFrame
    faults: DataFrame | None = None
    reports: DataFrame | None = None
    annexes: DataFrame | None = None
    stop_order: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()

    def one(self, name: str) -> DataFrame:
        """The known rows of a frame, checked where that is asked for."""
        keys = {"circuits": ["inc_cid"], "annexes": [KEY, "annex_component"]}.get(name, [KEY, "word_component"] if name in WORD_FRAMES else [KEY])
        rows = known(keyed(getattr(self, name)), keys[0])
        return unique(rows, keys, name) if name in self.unique else rows

    def checked(self) -> Inputs:
        """These inputs with every named frame checked; the rows without a key are not."""
        wrong = set(self.unique) - {"cut", "incidents", "circuits", *WORD_FRAMES, "annexes"}
        if wrong:
            raise ValueError(f"no such frames: {sorted(wrong)}")
        if "cut" not in self.unique:
            return self
        rows = unique_beside(keyed(self.cut), [KEY], "cut", ~F.col(KEY).isin(*MISSING))
        return replace(self, cut=replace(self.cut, keyed=rows) if isinstance(self.cut, Late) else rows)


WORD_FRAMES = ("faults", "reports")


def keyed(given: DataFrame | Late) -> DataFrame:
    """What a join on the key takes of an input."""
    return given.keyed if isinstance(given, Late) else given


def ready(rows: DataFrame, *given: DataFrame | Late) -> DataFrame:
    """Joined rows with the columns of the inputs that are cleaned behind the join."""
    for x in given:
        rows = x.fields(rows) if isinstance(x, Late) else rows
    return rows


def known(df: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose key is there.  One side of each join is cut to these, so missing keys meet no others."""
    return df.where(~F.col(key).isin(*MISSING))


def compared(inputs: Inputs) -> DataFrame:
    """Cut rows found in the incident extract, with circuit data."""
    inputs = inputs.checked()
    rows = ready(matched(keyed(inputs.cut), inputs.one("incidents"), [KEY]), inputs.cut, inputs.incidents)
    return with_circuits(rows, inputs)


def with_circuits(rows: DataFrame, inputs: Inputs) -> DataFrame:
    """Rows, dealt by ticket, with the data of their incident's circuit.

    Circuits are put beside the (ticket, circuit) pairs of the incidents, which are narrow, and these beside
    the rows; so no whole row is dealt by circuit.
    """
    pairs = ready(known(keyed(inputs.incidents)), inputs.incidents).select(KEY, "inc_cid").distinct()
    return enrich(rows, matched(pairs, inputs.one("circuits"), ["inc_cid"]), [KEY, "inc_cid"], dealt=[KEY])


def every_cut_row(inputs: Inputs) -> DataFrame:
    """All cut rows with what the incident extract has of them; ``FOUND`` tells whether it has any."""
    inputs = inputs.checked()
    rows = enrich(keyed(inputs.cut), inputs.one("incidents").withColumn(FOUND, F.lit(True)), [KEY], {FOUND: False})
    rows = ready(rows, inputs.cut, inputs.incidents)  # what a missing incident would read is asked nowhere
    return with_circuits(rows, inputs)


def _with_stops(rows: DataFrame, inputs: Inputs) -> DataFrame:
    return with_stops(
        rows, inputs.stops, ready(known(keyed(inputs.incidents)), inputs.incidents), KEY, "inc_start", "inc_end", order=inputs.stop_order
    )


def reconciled(inputs: Inputs) -> DataFrame:
    """Cut rows found in the incident extract, with circuit data and stops."""
    return _with_stops(compared(inputs), inputs)


def unmatched(inputs: Inputs) -> DataFrame:
    """Cut rows the incident extract does not have."""
    return ready(only_left(keyed(inputs.cut), known(keyed(inputs.incidents)), [KEY]), inputs.cut)


def _documented() -> Column:
    """Whether a cut row's component has a document."""
    return F.col("cut_component").isin(DATA, VOICE)


def _claim() -> Column:
    return (F.col("tipo_reporte") == CLAIM) & _documented()


def claims(cut: DataFrame) -> DataFrame:
    return cut.where(_claim())


def claims_missing(cut: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims whose component's document does not have their ticket."""
    return _absent(claims(cut), documents)


def _absent(cut: DataFrame, documents: DataFrame) -> DataFrame:
    have = known(documents).select(KEY, F.col("word_component").alias("cut_component"))
    return only_left(cut, have, [KEY, "cut_component"])


def missing_findings(cut: DataFrame, documents: DataFrame, rule: Rule) -> DataFrame:
    """Findings of a rule on ``claims_missing``.

    The rule asks what is a claim, not a filter: pushed into the cleaning of every cell, a filter makes the
    optimizer infer conditions until the driver's memory is full, however few the rows.
    """
    return _evaluate(_absent(cut, documents), [_only_where(rule, _claim())])


def with_annex(rows: DataFrame, annexes: DataFrame) -> DataFrame:
    """Rows of the two components with their annex, ``no encontrado`` where absent."""
    return _beside_annex(rows.where(_documented()), annexes)


def _beside_annex(rows: DataFrame, annexes: DataFrame) -> DataFrame:
    annex = known(annexes).withColumnRenamed("annex_component", "cut_component")
    defaults = {c: NOT_FOUND for c in ("annex_header", "annex_periods", "annex_total")}
    return enrich(rows, annex, [KEY, "cut_component"], defaults, dealt=[KEY])


def _evaluate(df: DataFrame, rules) -> DataFrame:
    return evaluate(df, rules, KEY, "tipo_reporte", F.col("row"))


def _only_where(rule: Rule, rows: Column) -> Rule:
    return replace(rule, when=rows if rule.when is None else rows & rule.when)


def cut_findings(
    rows: DataFrame,
    outage_block_rule: bool = False,
    check_monitoring: bool = False,
    own: Column | None = None,
    extra: Sequence[Rule] = (),
) -> DataFrame:
    """Rule set 1 in one pass over all cut rows (``every_cut_row`` with stops).

    ``own`` limits it to some rows; ``extra`` rules are asked in the same pass.
    """
    own = F.lit(True) if own is None else own
    rows = with_rule_columns(rows)
    if outage_block_rule:
        rows = with_block(rows)
    rules = [_only_where(r, own & F.col(FOUND)) for r in cut_rules(outage_block_rule, check_monitoring)]
    return _evaluate(rows, [_only_where(missing_incident(), own & ~F.col(FOUND)), *rules, *extra])


def reconciled_cut(inputs: Inputs) -> DataFrame:
    """All cut rows with circuit data and stops."""
    return _with_stops(every_cut_row(inputs), inputs)


#: Which document a word row is from, in ``with_words``.
WORD, FAULTS, REPORTS = "_word", "faults", "reports"


def _mark(document: str, component: str) -> str:
    return f"_{document}_{component}"


def with_words(cut: DataFrame | Late, faults: DataFrame | None, reports: DataFrame | None, once: Sequence[str] = ()) -> DataFrame:
    """Cut rows for themselves and beside each row that a word document has of their ticket, in one join.

    The former bear a mark for each document and component that has the ticket.  A document named by ``once`` that repeats a
    ticket of a component raises.
    """
    rows = None
    for name, df in ((FAULTS, faults), (REPORTS, reports)):
        if df is not None:
            part = known(df).withColumn(WORD, F.lit(name))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    here = lambda document, component: (F.col(WORD) == document) & (F.col("word_component") == component)
    marks = {_mark(d, k): F.max(F.coalesce(here(d, k), F.lit(False))) for d in (FAULTS, REPORTS) for k in (DATA, VOICE)}
    again = F.when(F.col(WORD).isin(*once), repeated(F.col(WORD), [KEY, "word_component"])) if once else None
    return ready(mark_join(keyed(cut), rows, [KEY], marks, once=([WORD, "word_component"], again) if once else None), cut)


def word_findings(
    cut: DataFrame | Late, faults: DataFrame | None, reports: DataFrame | None, once: Sequence[str] = ()
) -> DataFrame | None:
    """Rule set 2 in one pass: missing claims on the rows that stand for themselves, fields on the paired ones."""
    given = {FAULTS: (faults, claim_not_in_faults(), fault_fields()), REPORTS: (reports, claim_not_in_reports(), report_fields())}
    rules = []
    for name, (df, missing, fields) in given.items():
        if df is not None:
            has = F.when(F.col("cut_component") == DATA, F.col(_mark(name, DATA))).otherwise(F.col(_mark(name, VOICE)))
            claim = (F.col("tipo_reporte") == CLAIM) & F.col("cut_component").isin(DATA, VOICE)
            rules.append(_only_where(missing, ~F.col(PAIRED) & claim & ~F.coalesce(has, F.lit(False))))
            rules.append(_only_where(fields, F.col(PAIRED) & (F.col(WORD) == name)))
    return _evaluate(with_words(cut, faults, reports, once), rules) if rules else None


def annex_findings(matched_rows: DataFrame, annexes: DataFrame) -> DataFrame:
    """Rule set 3, on the rows of ``with_annex``; asked by the rule, as in ``missing_findings``."""
    return _evaluate(_beside_annex(matched_rows, annexes), [_only_where(annex_fields(), _documented())])


#: Whether any annex has the ticket and component of a row that stands for itself.
ANNEXED = "_annexed"


def cut_and_annex_findings(rows: DataFrame, annexes: DataFrame, once: bool = False, **options) -> DataFrame:
    """Rule sets 1 and 3 in one pass over all cut rows (``reconciled_cut``).

    Set 1 is asked on the rows that stand for themselves, 3.1 on those paired with an annex, and on the
    former where no annex has the ticket.  With ``once`` annexes that repeat a ticket of a component raise.
    """
    annex = known(annexes).withColumnRenamed("annex_component", "cut_component")
    again = repeated("annexes", {KEY: KEY, "annex_component": "cut_component"})
    marks = {ANNEXED: F.lit(True)}
    rows = mark_join(rows, annex, [KEY, "cut_component"], marks, dealt=[KEY], once=([], again) if once else None)
    rows = rows.fillna({c: NOT_FOUND for c in ("annex_header", "annex_periods", "annex_total")})
    asked = F.col(FOUND) & F.col("cut_component").isin(DATA, VOICE) & (F.col(PAIRED) | F.col(ANNEXED).isNull())
    return cut_findings(rows, own=~F.col(PAIRED), extra=[_only_where(annex_fields(), asked)], **options)


def findings(
    inputs: Inputs, share: Callable[[DataFrame], DataFrame] | None = None, **options
) -> DataFrame:
    """All findings in long form.

    The reconciled rows are read in one pass by rule sets 1 and 3, the cut in one more by
    set 2.  ``share`` is applied to the reconciled rows; ``plans.shared.checkpointed`` writes
    them to the shared folder, so that nothing before them is worked out again.
    """
    rows = reconciled_cut(inputs)
    if share is not None:
        rows = share(rows)
    if inputs.annexes is None:
        parts = [cut_findings(rows, **options)]
    else:
        parts = [cut_and_annex_findings(rows, keyed(inputs.annexes), "annexes" in inputs.unique, **options)]
    word = word_findings(inputs.cut, inputs.faults, inputs.reports, [n for n in WORD_FRAMES if n in inputs.unique])
    if word is not None:
        parts.append(word)
    return union_all(parts)


def validate(
    inputs: Inputs, share: Callable[[DataFrame], DataFrame] | None = None, **options
) -> DataFrame:
    """One row per failing ticket: messages, rule codes and report type."""
    return by_ticket(findings(inputs, share, **options))
