"""From feature definitions to one projection: order by dependence, prune inputs, bucketise, dump."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bucketize import Bucketizer
from ..operators.features import Feature, SequenceGroup, side_of
from ..sources.session import configure


def expand(features: list[Feature | SequenceGroup]) -> list[Feature]:
    out: list[Feature] = []
    for f in features:
        out.extend(f.features() if isinstance(f, SequenceGroup) else [f])
    names = [f.name for f in out]
    if len(set(names)) != len(names):
        raise ValueError(f"repeated feature names: {sorted({n for n in names if names.count(n) > 1})}")
    return out


def levels(features: list[Feature]) -> list[list[Feature]]:
    """Features in rounds: each needs only source columns and features of earlier rounds."""
    names = {f.name for f in features}
    needs = {f.name: {side_of(i)[1] for i in f.inputs if side_of(i)[0] == "feature"} for f in features}
    for name, own in needs.items():
        if missing := own - names:
            raise ValueError(f"{name} needs unknown features {sorted(missing)}")
    done: set[str] = set()
    rounds: list[list[Feature]] = []
    left = list(features)
    while left:
        ready = [f for f in left if needs[f.name] <= done]
        if not ready:
            raise ValueError(f"features depend on one another in a circle: {sorted(f.name for f in left)}")
        rounds.append(ready)
        done |= {f.name for f in ready}
        left = [f for f in left if f.name not in done]
    return rounds


@dataclass(frozen=True)
class FeaturePlan:
    """Features over one table.  Modes: dag (all inputs), normal (no feature inputs), bucketize (values are ready, ids only), none."""

    features: list[Feature | SequenceGroup]
    mode: str = "dag"
    seed: int = 0

    def source_columns(self) -> list[str]:
        """Columns to read: nothing else needs to leave the scan."""
        found = [side_of(i)[1] for f in expand(self.features) for i in f.inputs if side_of(i)[0] not in ("const", "feature")]
        return list(dict.fromkeys(found))

    def apply(self, df: DataFrame, reserved: list[str] = (), training: bool = False) -> DataFrame:
        """Reserved columns and all features that are no stubs."""
        configure(df.sparkSession)
        features = expand(self.features)
        if self.mode == "none":
            return df.select(*reserved, *[F.col(f"`{f.name}`") for f in features if not f.stub])
        if self.mode == "normal" and any(side_of(i)[0] == "feature" for f in features for i in f.inputs):
            raise ValueError("feature inputs need mode dag")
        if self.mode == "bucketize":
            return df.select(*reserved, *[f.bucketed(F.col(f"`{f.name}`")).alias(f.name) for f in features if not f.stub])
        if training:
            # one draw for each row and feature, kept in a column of its own: an input may occur in several places
            df = df.withColumns({f"__m_{f.name}": F.rand(self.seed + n) < f.mask_share for n, f in enumerate(features) if f.mask_share})
        for ready in levels(features):
            kinds = {f.name: f.dataType.simpleString() for f in df.schema}

            def resolve(i: str, kinds=kinds) -> tuple[Column, str]:
                side, name = side_of(i)
                if side == "const":
                    return F.lit(name), "string"
                column = f"__f_{name}" if side == "feature" else name
                if column not in kinds:
                    raise ValueError(f"no column {name!r} for input {i!r}")
                return F.col(f"`{column}`"), kinds[column]

            def masked(f: Feature, resolve=resolve):
                """In training the first input that is no map is missing in a share of the rows."""
                if not (training and f.mask_share):
                    return resolve
                first = next((i for i in f.inputs if not resolve(i)[1].startswith("map<")), None)
                hidden = F.col(f"`__m_{f.name}`")
                return lambda i: (F.when(~hidden, resolve(i)[0]), resolve(i)[1]) if i == first else resolve(i)

            df = df.withColumns({f"__f_{f.name}": f.column(masked(f)) for f in ready})
        return df.select(*reserved, *[F.col(f"`__f_{f.name}`").alias(f.name) for f in features if not f.stub])

    def to_json(self, with_buckets: bool = True) -> str:
        """The plan as JSON; without buckets it gives raw values for another consumer to discretise."""
        rows = []
        for f in expand(self.features):
            d = {"kind": type(f).__name__} | {k: v for k, v in asdict(f if with_buckets else replace(f, buckets=Bucketizer())).items() if v not in (None, [], {}, False, 0.0)}
            d["buckets"] = {k: v for k, v in (d.get("buckets") or {}).items() if v not in (None, False)}
            rows.append({k: v for k, v in d.items() if v != {}})
        return json.dumps({"mode": self.mode, "features": rows}, indent=1, sort_keys=True)


def debug_dump(df: DataFrame, features: list[str], weighted: list[str] = ()) -> Column:
    """`name:v1,v2 | name2:...` of each row; weighted items sorted as id:weight."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def shown(name: str) -> Column:
        c = F.col(f"`{name}`")
        if name in weighted:
            c = F.array_sort(F.transform(c, lambda s: F.concat_ws(":", s["id"], s["weight"])))
        elif kinds[name].startswith("array<array<"):
            c = F.transform(c, lambda s: F.array_join(F.transform(s, lambda x: x.cast("string")), "\x03"))
        elif kinds[name].startswith("array<"):
            c = F.transform(c, lambda x: x.cast("string"))
        else:
            c = F.array(c.cast("string"))
        return F.concat(F.lit(f"{name}:"), F.coalesce(F.array_join(c, ","), F.lit("")))

    return F.concat_ws(" | ", *[shown(n) for n in features])
