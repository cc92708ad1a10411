"""Samplers: what a column's values look like, as a Column over row ids."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .random import Draw, weighted_index
from .seasonality import day_weights, hour_weights, to_date

FIRST = "Ada Amir Ana Aroha Astrid Bao Bea Chidi Clara Dario Dina Ebru Elif Emil Esra Farah Felix Gael Hana Hugo Ines Ivan Jomo Kaia Kenji Lena Leo Lin Maya Milo Nadia Noor Omar Pia Quinn Rosa Sami Tara Uma Zane".split()
LAST = "Abara Aydin Becker Bianchi Castro Chen Cohen Dubois Egger Fischer Garcia Haddad Hansen Ito Jansen Kaur Keita Kim Lopez Mbeki Meyer Moreau Nakamura Novak Okafor Olsen Patel Petrov Rossi Santos Schmidt Silva Singh Tanaka Weber Yilmaz".split()
CITIES = ["Accra", "Auckland", "Bergen", "Bogota", "Cairo", "Chennai", "Cork", "Dakar", "Denver", "Geneva", "Hanoi", "Helsinki", "Izmir", "Kyoto", "Lagos", "Leeds", "Lima", "Lyon", "Malaga", "Nairobi", "Osaka", "Porto", "Quito", "Riga", "Seoul", "Tampa", "Turin", "Utrecht", "Vienna", "Winnipeg"]
COUNTRIES = ["Austria", "Brazil", "Canada", "Chile", "Egypt", "Finland", "France", "Germany", "Ghana", "India", "Ireland", "Italy", "Japan", "Kenya", "Mexico", "Norway", "Peru", "Portugal", "Senegal", "Spain", "Turkey"]
STREETS = ["Oak Street", "Mill Lane", "High Road", "Station Way", "River Walk", "Park Avenue", "Church Hill", "Garden Row", "Harbour View", "School Close"]
WORDS = "amber basin cedar delta ember field grove haven inlet jetty knoll ledge marsh north ocean prairie quarry ridge shore terrace upland valley willow yonder".split()
DOMAINS = ["example.com", "example.org", "example.net", "mail.example.com"]
START, END = dt.date(2024, 1, 1), dt.date(2026, 1, 1)


def pick(draw: Draw, values: list, stream: str = "") -> Column:
    return F.get(F.lit(values), draw.below(len(values), stream).cast("int"))


def _at_second(day: Column, second: Column) -> Column:
    return F.timestamp_add("SECOND", second.cast("int"), day.cast("timestamp_ntz"))


def sequence(d: Draw, start: int = 1) -> Column:
    return d.row + F.lit(int(start))


def uuid(d: Draw) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(f"{d.seed}|{d.table}|{d.column}"), d.row.cast("string")))
    return F.regexp_replace(digest, r"^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-4$3-a$4-$5")


def choice(d: Draw, values: list, weights: list[float] | None = None) -> Column:
    """Values keep their type."""
    return F.get(F.lit(list(values)), weighted_index(d, list(weights or [1.0] * len(values))))


def full_name(d: Draw) -> Column:
    return F.concat_ws(" ", pick(d, FIRST, "first"), pick(d, LAST, "last"))


def email(d: Draw) -> Column:
    name = F.concat(F.lower(pick(d, FIRST, "first")), F.lit("."), F.lower(pick(d, LAST, "last")))
    return F.concat(name, (d.below(998, "n") + 1).cast("string"), F.lit("@"), pick(d, DOMAINS, "at"))


def phone(d: Draw) -> Column:
    return F.format_string("+1-%d-%d-%d", d.below(799, "a") + 200, d.below(799, "b") + 200, d.below(8999, "c") + 1000)


def address(d: Draw) -> Column:
    return F.concat((d.below(9998, "n") + 1).cast("string"), F.lit(" "), pick(d, STREETS, "street"), F.lit(", "), pick(d, CITIES, "city"))


def lognormal(d: Draw, mean: float = 100.0, sigma: float = 0.6) -> Column:
    mu = math.log(max(mean, 0.01)) - sigma**2 / 2
    return F.round(F.exp(F.lit(mu) + F.lit(float(sigma)) * d.normal()), 2)


def normal(d: Draw, mean: float = 0.0, std: float = 1.0, min: float | None = None, max: float | None = None, as_int: bool = False) -> Column:
    out = F.lit(float(mean)) + F.lit(float(std)) * d.normal()
    if min is not None:
        out = F.greatest(out, F.lit(float(min)))
    if max is not None:
        out = F.least(out, F.lit(float(max)))
    return F.round(out).cast("bigint") if as_int else F.round(out, 4)


def uniform_int(d: Draw, min: int = 0, max: int = 100) -> Column:
    return d.below(int(max) - int(min) + 1) + int(min)


def poisson(d: Draw, lam: float = 3.0, min: int = 0) -> Column:
    """A Poisson number of mean lam - min above min; beyond mean 200 the normal law stands for it."""
    rate = lam - min if lam - min > 0.1 else 0.1
    if rate > 200:
        return F.greatest(F.round(F.lit(rate) + F.lit(math.sqrt(rate)) * d.normal()), F.lit(0.0)).cast("bigint") + int(min)
    last = int(rate + 10 * math.sqrt(rate) + 12)
    weights = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(last + 1)]
    return weighted_index(d, weights).cast("bigint") + int(min)


def bool_(d: Draw, p_true: float = 0.5) -> Column:
    return d.uniform() < F.lit(float(p_true))


def date(d: Draw, start: Any = START, end: Any = END) -> Column:
    first, last = to_date(start), to_date(end)
    return F.date_add(F.lit(first), d.below((last - first).days + 1, "day").cast("int"))


def datetime(d: Draw, start: Any = START, end: Any = END) -> Column:
    return _at_second(date(d, start, end), d.below(86400, "second"))


def _noisy(weights: list[float], noise: dict | None, draw_seed: int) -> list[float]:
    """The same noise for the whole table, however it is parted."""
    if not noise or not noise.get("sigma"):
        return weights
    import random

    rng, sigma = random.Random(draw_seed), float(noise["sigma"])
    if noise.get("kind", "lognormal") == "lognormal":
        return [w * math.exp(rng.gauss(-sigma * sigma / 2, sigma)) for w in weights]
    return [w * max(1 + rng.gauss(0, sigma), 0.0) for w in weights]


def seasonal_date(d: Draw, factor: dict, start: Any = START, end: Any = END) -> Column:
    first, last = to_date(start), to_date(end)
    weights = _noisy(day_weights(factor, first, last), factor.get("noise"), d.seed)
    return F.date_add(F.lit(first), weighted_index(d, weights, "day").cast("int"))


def seasonal_datetime(d: Draw, factor: dict, start: Any = START, end: Any = END) -> Column:
    hour = weighted_index(d, hour_weights(factor), "hour")
    return _at_second(seasonal_date(d, factor, start, end), hour * 3600 + d.below(3600, "second"))


def template(d: Draw, pattern: str) -> Column:
    """# is a digit, ? a capital letter, anything else itself."""
    parts = []
    for k, m in enumerate(re.finditer(r"#+|\?|[^#?]+", pattern)):
        run = m[0]
        if run[0] == "#":
            for at in range(0, len(run), 15):
                n = min(15, len(run) - at)
                parts.append(F.lpad(d.below(10**n, f"{k}.{at}").cast("string"), n, "0"))
        elif run == "?":
            parts.append(pick(d, [chr(65 + i) for i in range(26)], str(k)))
        else:
            parts.append(F.lit(run))
    return F.concat(*parts) if parts else F.lit("")


def words(d: Draw, k: int = 2) -> Column:
    return F.concat_ws(" ", *[pick(d, WORDS, str(i)) for i in range(k)])


SAMPLERS: dict[str, Callable[..., Column]] = {
    "sequence": sequence, "uuid": uuid, "choice": choice, "full_name": full_name, "email": email, "phone": phone, "address": address,
    "city": lambda d: pick(d, CITIES), "country": lambda d: pick(d, COUNTRIES), "lognormal": lognormal, "normal": normal, "uniform_int": uniform_int,
    "poisson": poisson, "bool": bool_, "date": date, "datetime": datetime, "seasonal_date": seasonal_date, "seasonal_datetime": seasonal_datetime,
    "template": template, "words": words,
}


def register_sampler(name: str, make: Callable[..., Column]) -> None:
    """Adds or replaces a sampler: make(draw, **params) gives a Column."""
    SAMPLERS[name] = make


def sample(name: str, draw: Draw, **params: Any) -> Column:
    """An unknown sampler gives two words."""
    return SAMPLERS[name](draw, **params) if name in SAMPLERS else words(draw)


def lognormal_sigma(mean: float, std: float | None) -> float:
    """The sigma whose lognormal has this mean and deviation, kept within 0.1 and 2.5; 0.6 where it isn't defined."""
    if not std or mean <= 0:
        return 0.6
    return min(max(math.sqrt(math.log1p((std / mean) ** 2)), 0.1), 2.5)
