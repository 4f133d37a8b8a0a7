"""Receipts from seeds, and a simulated engine that misreads them; both keyed by a seed column alone."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Word lists of the generator.  Other languages are added the same way.
BANKS = {
    "en": (("Corner", "Golden", "Sunny", "Green"), ("Store", "Market", "Bakery", "Cafe"), ("Main Street", "Oak Avenue"), ("Springfield", "Riverton"), ("Milk", "Bread", "Apples", "Coffee"), "USD"),
    "fr": (("Petit", "Grand", "Joli"), ("Marché", "Café", "Magasin"), ("Rue de la Paix", "Rue Verte"), ("Lyon", "Lille"), ("Lait", "Pain", "Pommes", "Café"), "EUR"),
    "de": (("Alte", "Neue", "Kleine"), ("Bäckerei", "Metzgerei", "Apotheke"), ("Hauptstraße", "Gartenweg"), ("Köln", "Bonn"), ("Milch", "Brot", "Äpfel", "Kaffee"), "EUR"),
    "es": (("Buena", "Gran", "Nueva"), ("Tienda", "Panadería", "Cafetería"), ("Calle Mayor", "Calle Sol"), ("Sevilla", "Bilbao"), ("Leche", "Pan", "Manzanas", "Café"), "EUR"),
}
SCHEMA = "language string, seed long, merchant string, address string, date string, time string, currency string, items array<struct<description:string,quantity:int,unit_price:double,item_total:double>>, subtotal double, tax double, total double, lines array<string>"


def receipt(language: str, seed: int) -> tuple:
    r, (first, second, streets, cities, goods, currency) = random.Random(seed), BANKS[language]
    merchant = f"{r.choice(first)} {r.choice(second)}"
    address = f"{r.randint(1, 999)} {r.choice(streets)}, {r.choice(cities)}"
    date = f"{r.randint(2022, 2026)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
    time = f"{r.randint(8, 21):02d}:{r.randint(0, 59):02d}"
    items = []
    for _ in range(r.randint(3, 6)):
        name, q, u = r.choice(goods), r.randint(1, 4), round(r.uniform(0.99, 24.99), 2)
        items.append((name, q, u, round(q * u, 2)))
    subtotal = round(sum(i[3] for i in items), 2)
    tax = round(subtotal * 0.07, 2)
    total = round(subtotal + tax, 2)
    lines = [merchant, address, f"{date} {time}", *(f"{n} {q} x {u:.2f} {t:.2f}" for n, q, u, t in items), f"SUBTOTAL {subtotal:.2f}", f"TAX {tax:.2f}", f"TOTAL {total:.2f} {currency}"]
    return (language, seed, merchant, address, date, time, currency, items, subtotal, tax, total, lines)


def generate(cases: DataFrame) -> DataFrame:
    """Receipts with their truth for rows (language, seed)."""
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [receipt(a, int(s)) for a, s in zip(pdf["language"], pdf["seed"], strict=True)]
            yield pd.DataFrame([(*x[:7], [dict(zip(("description", "quantity", "unit_price", "item_total"), i, strict=True)) for i in x[7]], *x[8:]) for x in rows], columns=names)

    return cases.select("language", "seed").mapInPandas(run, SCHEMA)


class Engine:
    """What a recognition engine offers; one is opened for each Python worker."""

    name = "abstract"

    @classmethod
    def is_available(cls) -> bool:
        return False

    @classmethod
    def supported_languages(cls) -> list[str]:
        return []

    def recognize(self, lines: list[str], seed: int, rate: float) -> list[str]:
        raise NotImplementedError

    def close(self) -> None:
        """Nothing by default."""


class NoisyEngine(Engine):
    """Reads the truth and swaps, drops or doubles letters at a rate.  A simulation, not recognition."""

    name = "noisy"

    @classmethod
    def is_available(cls) -> bool:
        return True

    @classmethod
    def supported_languages(cls) -> list[str]:
        return sorted(BANKS)

    def recognize(self, lines: list[str], seed: int, rate: float) -> list[str]:
        r = random.Random(seed)
        wrong = lambda c: r.choice(("", c + c, r.choice("abcdefghijklmnopqrstuvwxyz")))
        return ["".join(wrong(c) if c.isalpha() and r.random() < rate else c for c in x) for x in lines]


ENGINES = {"noisy": NoisyEngine}


def engine_of(name: str) -> Engine:
    if name not in ENGINES:
        raise ValueError(f"UNSUPPORTED_BACKEND: {name}; known: {', '.join(ENGINES)}")
    return ENGINES[name]()


def default_engine() -> str:
    """The first engine that is available."""
    for name, engine in ENGINES.items():
        if engine.is_available():
            return name
    raise ValueError("UNSUPPORTED_BACKEND: no engine is available")


def recognize(receipts: DataFrame, backend: str = "noisy", rate: float = 0.02) -> DataFrame:
    """(language, seed, lines) as an engine reads them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = engine_of(backend)
        try:
            for pdf in batches:
                yield pd.DataFrame({"language": pdf["language"], "seed": pdf["seed"], "lines": [engine.recognize(list(x), int(s), rate) for x, s in zip(pdf["lines"], pdf["seed"], strict=True)]})
        finally:
            engine.close()

    return receipts.select("language", "seed", "lines").mapInPandas(run, "language string, seed long, lines array<string>")
