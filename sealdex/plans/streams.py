"""A stream of lines in a vault: what of it counts, and where it ends.

The ledger keeps, for each named stream, the place of the end line in every
ordered group, the segment (how many ends were passed), and whether the caller
took note of the end. Each batch knows its stream and segment, and each line its
place. A batch is cut at the known end while it is sealed. When an end line turns
up, batches of the segment that came too early are cut as well, in the same
commit: their lines behind the end are opened by the writer and wait, sealed again,
for the next segment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sealdex.operators import sealing
from sealdex.operators.keyring import Keyring, key_column
from sealdex.operators.sealing import LINE_BODY, LINE_CLASS, PLACE, REJECTED, SEALED_LINE, WAITING
from sealdex.plans import vault as vault_module
from sealdex.plans.vault import WAITED, IngestReport, Secrets, Vault
from sealdex.sources.records import FAULT, LINE, judged_lines

#: Ends the name of an ordered group within a place; sorts below all text.
GROUP_END = "\x1d"


class VaultStream:
    def __init__(self, vault: Vault, secrets: Secrets, name: str, end: str):
        self.vault = vault
        self.secrets = secrets
        self.name = name
        self.end = end

    # --- what the ledger says ---

    def _said(self) -> dict:
        return self.vault.ledger.fact(f"stream/{self.name}", {"segment": 0, "cuts": {}, "noted": False})

    def _say(self, **changes) -> None:
        self.vault.ledger.note(f"stream/{self.name}", self._said() | changes)

    def _epochs(self) -> list[str]:
        """Key epochs of the stream, the one in use last."""
        return [self.name, *(f"{self.name}~{k}" for k in range(1, self._said().get("epoch", 0) + 1))]

    def _epoch(self) -> str:
        """The epoch to seal with: a new one begins once half of what one may hold is sealed."""
        used = self._epochs()[-1]
        if self.vault.epoch_records(used) <= vault_module.EPOCH_RECORDS // 2:
            return used
        self._say(epoch=self._said().get("epoch", 0) + 1)
        return self._epochs()[-1]

    @property
    def ended(self) -> bool:
        return bool(self._said()["cuts"])

    def take_note(self) -> None:
        self._say(noted=True)

    def _batches(self, segment: int) -> list[int]:
        mine = {"stream": self.name, "segment": segment}
        return [p.batch for p in self.vault.records.pieces() if mine.items() <= p.info.items()]

    # --- cutting ---

    def _behind(self, cuts: dict[str, str]) -> Column:
        """Whether a place is behind the end of its group; cuts are as many as ordered groups."""
        if not cuts:
            return F.lit(False)
        group = F.substring_index(PLACE, GROUP_END, 1)
        if len(cuts) == 1:
            ((name, cut),) = cuts.items()
            return F.coalesce((group == F.lit(name)) & (F.col(PLACE) > F.lit(cut)), F.lit(False))
        named = F.map_from_arrays(F.array(*map(F.lit, cuts)), F.array(*map(F.lit, cuts.values())))
        return F.coalesce(F.col(PLACE) > F.element_at(named, group), F.lit(False))

    def _is_end(self) -> Column:
        return F.trim(LINE) == F.lit(self.end)

    def _ends(self, lines: DataFrame) -> dict[str, str]:
        group = F.substring_index(PLACE, GROUP_END, 1).alias("g")
        ends = lines.where(F.trim("value") == F.lit(self.end)).groupBy(group).agg(F.min(PLACE).alias("cut"))
        return {r["g"]: r["cut"] for r in ends.collect()}

    # --- batches ---

    def ingest(self, lines: DataFrame, batch: int, strict: bool = False) -> IngestReport:
        """(value, place) lines as one batch, cut at the end that is known by then."""
        vault = self.vault
        with vault.ledger.together():
            said = self._said()
            cuts, epoch = said["cuts"], self._epoch()
            info = {"stream": self.name, "segment": said["segment"]}
            seen, moved = Observation(), None

            def cut_at_end() -> DataFrame | None:
                """Once a stream: the batch is read again, now cut at its end line, before it is indexed."""
                nonlocal moved
                if not seen.get["ends"]:
                    return None
                found = self._ends(lines)
                moved = {g: c for g, c in found.items() if g not in cuts or c < cuts[g]}
                self._say(cuts=cuts | moved)
                return self._cut_lines(lines, cuts | moved, strict, Observation())

            report = vault._ingest(self._cut_lines(lines, cuts, strict, seen), self.secrets, batch, epoch, again=cut_at_end, **info)
            if moved is not None:
                self._cut_earlier([b for b in self._batches(said["segment"]) if b != batch], moved)
        return report

    def _cut_lines(self, lines: DataFrame, cuts: dict[str, str], strict: bool, seen: Observation) -> DataFrame:
        # The end line that made a cut is at it, and is not looked for again.
        behind = self._behind(cuts)
        judged = judged_lines(lines, self.vault.spec)
        fault = F.col(FAULT)
        if strict:
            bad = F.raise_error(F.concat(F.lit("bad record: "), fault)).cast("string")
            judged = judged.withColumn(FAULT, F.when(fault.isNotNull() & ~behind & ~self._is_end(), bad).otherwise(fault))
        judged = judged.observe(seen, F.count_if(self._is_end() & ~behind).alias("ends"))
        # The end line itself is neither a record nor a bad line; one behind it waits.
        judged = judged.where(behind | ~self._is_end())
        line_class = F.when(behind, F.lit(WAITING)).when(F.col(FAULT).isNotNull(), F.lit(REJECTED))
        return self.vault._as_lines(judged, line_class)

    def _cut_earlier(self, batches: list[int], cuts: dict[str, str]) -> None:
        """Take out of earlier batches what turned out to be behind the end."""
        vault = self.vault
        late = vault.records.read_placed(batches).where((F.col("class_token") != WAITING) & self._behind(cuts))
        # The folder's number holds the batch in its low bits.
        folders = {r["batch"] for r in late.select("batch").distinct().collect()}
        for piece in [p for p in vault.records.pieces() if p.batch in batches and p.folder in folders]:
            classes = reduce(DataFrame.unionByName, [vault._classes(self.secrets, e) for e in self._epochs()])
            rows = vault.records.read_placed([piece.batch])
            behind = (F.col("class_token") != WAITING) & self._behind(cuts)
            kept = rows.where(~behind).drop("batch")
            waiting = self._waiting_again(rows.where(behind), classes).select(kept.columns)
            vault.records.append(kept.unionByName(waiting), piece.batch, **piece.info)
            bad = vault.records.read_lines(REJECTED, [piece.batch]).limit(1).count()
            vault._set_aside(piece.batch, bad)
            vault._index_batch(piece.batch, classes, self.secrets)

    def _waiting_again(self, rows: DataFrame, classes: DataFrame) -> DataFrame:
        """Sealed rows as lines that wait, under their ids and places."""
        vault, spec = self.vault, self.vault.spec
        writer = self.secrets.writer().secrets(vault.spark)
        tokens = [r["class_token"] for r in classes.select("class_token").collect()]
        ring = Keyring(classes.select("class_token", *[key_column(p) for p in spec.part_names()]), tokens, frozenset(spec.part_names()))
        opened = sealing.open_records(rows.where(F.col("class_token") != REJECTED), ring, spec, (PLACE,))
        line = F.to_json(F.struct(*[F.col(n).cast("string").alias(n) for n in spec.fields]))
        lines = opened.select("file", "pos", PLACE, line.alias("value"))
        bad = rows.where(F.col("class_token") == REJECTED).select("file", "pos", PLACE, SEALED_LINE)
        bad = sealing.open_lines(bad, writer, "file", "pos", PLACE).drop("fault")
        body = sealing.line_body(F.col("value"), F.lit(None).cast("string"))
        lines = lines.unionByName(bad).select("file", "pos", PLACE, F.lit(WAITING).alias(LINE_CLASS), body.alias(LINE_BODY), *[F.lit(None).cast("string").alias(n) for n in spec.fields])
        return sealing.seal_records(lines, spec, classes.limit(0), writer)

    # --- segments ---

    def resume(self, strict: bool = False) -> IngestReport | None:
        """Go on behind an end that was taken note of: ingest the lines that wait there."""
        vault, said = self.vault, self._said()
        if not (said["cuts"] and said["noted"]):
            return None
        with vault.ledger.together():
            before = self._batches(said["segment"])
            self._say(segment=said["segment"] + 1, cuts={}, noted=False)
            if not before:
                return None
            sealed = vault.records.read_lines(WAITING, before)
            if sealed.isEmpty():
                return None
            lines = sealing.open_lines(sealed, self.secrets.writer().secrets(vault.spark), PLACE)
            return self.ingest(lines.select("value", PLACE), WAITED + said["segment"] + 1, strict)
