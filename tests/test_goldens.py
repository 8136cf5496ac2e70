"""Published results of the operators on two years of daily bars: numbers of results and single values.

The values stand in section 4 of FIXTURES.md, each as `row: field=value`, and `field=count` for
rows that have a result; here is only how its names are spelled.
"""

from __future__ import annotations

import csv
import datetime as dt
import os
import re

import pytest

from tickloom.plans.series import Series, pair
from tickloom.plans.spec import REGISTRY

HERE = os.path.dirname(os.path.abspath(__file__))
BAR = "series_key string, ts timestamp_ntz, open double, high double, low double, close double, volume double"

# Names of operators that are not their ids, and of fields that are not output names.
IDS = {
    "BollingerBands": "BB", "Chandelier": "CHEXIT", "ConnorsRsi": "CRSI", "Correlation": "CORR", "ForceIndex": "FORCE", "HtTrendline": "HTL", "MaEnvelopes": "MA-ENV", "ParabolicSar": "PSAR",
    "StarcBands": "STARC", "StdDev": "STDEV", "StdDevChannels": "STDEV-CHANNELS", "FisherTransform": "FISHER", "UlcerIndex": "ULCER", "Ultimate": "UO", "VolatilityStop": "VOL-STOP", "WilliamsR": "WILLR",
}
FIELDS = {("HEIKINASHI", x): f"ha_{x}" for x in ("open", "high", "low", "close", "volume")}
#: On data that are not here.
ELSEWHERE = {"Hurst", "Vwap"}


def bars(name):
    with open(f"{HERE}/data/{name}.csv") as f:
        rows = list(csv.DictReader(f))
    return [("x", dt.datetime.fromisoformat(r["date"]), *(float(r[c]) for c in ("open", "high", "low", "close", "volume"))) for r in rows]


def snake(name):
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def argument(text):
    """A number or the last word of a constant, as the operators spell it."""
    if re.fullmatch(r"-?[\d.]+m?", text):
        number = float(text.rstrip("m"))
        return int(number) if number.is_integer() and "." not in text else number
    return snake(text.rsplit(".", 1)[-1])


def goldens():
    path = os.path.join(os.path.dirname(HERE), "FIXTURES.md")
    if not os.path.exists(path):
        return
    with open(path) as f:
        part = f.read().split("## 4. Golden values")[1].split("\n## ")[0]
    for line in part.splitlines():
        cells = [c.strip() for c in line.strip("|").split("|")]
        call = re.search(r"`(Other)?Bars\.To(\w+)\((.*?)\)`", line)
        if len(cells) == 4 and call and cells[0] not in ELSEWHERE:
            yield pytest.param(cells[0], bool(call[1]), [x.strip() for x in call[3].split(",") if x.strip()], cells[2], cells[3], id=cells[0])


@pytest.fixture(scope="module")
def series(spark):
    return {name: Series(spark.createDataFrame(bars(name), BAR)).df.cache() for name in ("daily_bars", "daily_bars_other")}


def column_of(id, field, outputs):
    name = FIELDS.get((id, snake(field)), snake(field))
    return name if name in outputs else next(x for x in outputs if x.replace("_", "") == name.replace("_", ""))


@pytest.mark.parametrize(("name", "other", "arguments", "counts", "values"), list(goldens()))
def test_published_values(series, name, other, arguments, counts, values):
    id = IDS.get(name, next((x for x in REGISTRY if x.replace("-", "") == name.upper()), name))
    op = REGISTRY[id]
    one, two = (Series(series[x]) for x in ("daily_bars_other" if other else "daily_bars", "daily_bars" if other else "daily_bars_other"))
    given = [argument(x) for x in arguments if x not in ("Bars", "OtherBars")]
    made = pair(id, one, two, *given) if op.tier == "pair" else one.indicator(id, *given)
    order = ["ts", "brick_no"] if "brick_no" in op.outputs else ["ts"]
    rows = made.df.orderBy(*order).collect()
    checked = 0
    for field, count in re.findall(r"([^=;]+?(?: != [\w.]+)?)=(\d+)@", counts):
        field = field.strip()
        if " != " in field:
            column = column_of(id, field.split(" != ")[0], op.outputs)
            got = sum(1 for r in rows if r[column])
        elif field.lstrip("!") == "IsUp":
            got = sum(1 for r in rows if r.is_up != field.startswith("!"))
        else:
            column = column_of(id, field, op.outputs)
            got = sum(1 for r in rows if r[column] is not None)
        assert got == int(count), field
        checked += 1
    for row, field, value in re.findall(r"(\d+): (\w+)=(-?[\d.]+) @", values):
        got = rows[int(row)][column_of(id, field, op.outputs)]
        places = len(value.split(".")[1]) if "." in value else 0
        near = max(0.5001 * 10**-places, 5e-5)
        assert got is not None and abs(float(got) - float(value)) <= near, (row, field, got, value)
        checked += 1
    assert checked or not (counts or values)
