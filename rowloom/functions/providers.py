"""Named value providers: realistic-looking values from small word lists.

A provider is a function ``Draws -> Column``. Further ones are added with
``register``; a provider may also wrap a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions import rng

FIRST_NAMES = {
    "en": ["Alice", "Brian", "Carol", "David", "Emma", "Frank", "Grace", "Henry", "Irene", "James"],
    "de": ["Anke", "Bernd", "Clara", "Dieter", "Elke", "Fritz", "Greta", "Hans", "Inge", "Jonas"],
    "es": ["Ana", "Bruno", "Carmen", "Diego", "Elena", "Felipe", "Gloria", "Hugo", "Ines", "Javier"],
    "fr": ["Amelie", "Benoit", "Chloe", "Denis", "Elise", "Fabrice", "Gaelle", "Hugo", "Irene", "Jules"],
}
LAST_NAMES = {
    "en": ["Adams", "Baker", "Clark", "Davis", "Evans", "Foster", "Green", "Harris", "Irving", "Jones"],
    "de": ["Albrecht", "Becker", "Claus", "Dietrich", "Engel", "Fischer", "Graf", "Huber", "Jung", "Keller"],
    "es": ["Alonso", "Blanco", "Castro", "Delgado", "Espinosa", "Flores", "Garcia", "Herrera", "Iglesias", "Lopez"],
    "fr": ["Aubert", "Bernard", "Colin", "Dubois", "Etienne", "Fournier", "Girard", "Henry", "Lambert", "Moreau"],
}
CITIES = {
    "en": ["Ashford", "Bristol", "Camden", "Dover", "Easton", "Franklin", "Georgetown", "Hudson"],
    "de": ["Aachen", "Bremen", "Dresden", "Essen", "Freiburg", "Hamburg", "Jena", "Kassel"],
    "es": ["Almeria", "Bilbao", "Cadiz", "Girona", "Huelva", "Lugo", "Malaga", "Oviedo"],
    "fr": ["Angers", "Brest", "Dijon", "Lille", "Metz", "Nantes", "Reims", "Tours"],
}
STREETS = {
    "en": ["Oak Street", "Mill Lane", "High Street", "Park Avenue", "River Road", "Church Road"],
    "de": ["Hauptstrasse", "Gartenweg", "Bergstrasse", "Schulweg", "Ringstrasse", "Lindenallee"],
    "es": ["Calle Mayor", "Calle Real", "Avenida del Sol", "Calle Nueva", "Plaza Vieja", "Paseo del Mar"],
    "fr": ["Rue Haute", "Rue du Port", "Avenue Foch", "Rue Neuve", "Place Royale", "Quai du Nord"],
}
COMPANY_SUFFIXES = {
    "en": ["Ltd", "Inc", "Group", "Partners"],
    "de": ["GmbH", "AG", "KG", "Gruppe"],
    "es": ["SA", "SL", "Grupo", "Hermanos"],
    "fr": ["SA", "SARL", "Groupe", "Freres"],
}
COUNTRY_CODES = ["US", "GB", "DE", "FR", "ES", "IT", "NL", "SE", "PL", "JP", "BR", "CA"]
WORDS = [
    "amber", "basin", "cedar", "delta", "ember", "field", "grove", "harbor",
    "island", "jetty", "knoll", "ledge", "meadow", "north", "orchard", "prairie",
]


def language(locale: str) -> str:
    """Word-list language of a locale such as ``de_DE``; English where there is none."""
    short = locale[:2].lower()
    return short if short in FIRST_NAMES else "en"


@dataclass(frozen=True)
class Draws:
    """The random source of one generated column."""

    seed: int
    tag: str
    key: str
    locale: str = "en_US"

    def uniform(self, part: str = "") -> Column:
        return rng.uniform(self.seed, self._tag(part), self.key)

    def integer(self, low: int, high: int, part: str = "") -> Column:
        return rng.randint(self.seed, self._tag(part), self.key, low, high)

    def pick(self, options: Sequence[Any], part: str = "") -> Column:
        return rng.choose(self.seed, self._tag(part), self.key, options)

    def words(self, lists: dict[str, list[str]], part: str) -> Column:
        return self.pick(lists[language(self.locale)], part)

    def _tag(self, part: str) -> str:
        return f"{self.tag}.{part}" if part else self.tag


def person(d: Draws) -> Column:
    return F.concat_ws(" ", d.words(FIRST_NAMES, "first"), d.words(LAST_NAMES, "last"))


def email(d: Draws) -> Column:
    return F.concat(
        F.lower(d.words(FIRST_NAMES, "first")),
        F.lit("."),
        F.lower(d.words(LAST_NAMES, "last")),
        d.integer(1, 9999, "number").cast("string"),
        F.lit("@example."),
        d.pick(["com", "org", "net"], "domain"),
    )


def phone(d: Draws) -> Column:
    return F.concat(
        F.lit("+1-"),
        d.integer(200, 999, "area").cast("string"),
        F.lit("-555-"),
        F.lpad(d.integer(0, 9999, "line").cast("string"), 4, "0"),
    )


def company(d: Draws) -> Column:
    return F.concat_ws(" ", d.words(LAST_NAMES, "owner"), d.words(COMPANY_SUFFIXES, "suffix"))


def city(d: Draws) -> Column:
    return d.words(CITIES, "city")


def address(d: Draws) -> Column:
    return F.concat(
        d.integer(1, 999, "house").cast("string"),
        F.lit(" "),
        d.words(STREETS, "street"),
        F.lit(", "),
        d.words(CITIES, "city"),
    )


def country(d: Draws) -> Column:
    return d.pick(COUNTRY_CODES, "country")


def url(d: Draws) -> Column:
    return F.concat(
        F.lit("https://"),
        d.pick(WORDS, "host"),
        d.integer(1, 999, "number").cast("string"),
        F.lit(".example.com/"),
        d.pick(WORDS, "page"),
    )


def uuid(d: Draws) -> Column:
    """128 bits from the whole key, so no two rows share one."""
    digest = F.md5(F.concat(F.lit(f"{d.seed}/{d.tag}/"), F.expr(d.key).cast("string")))
    return F.concat_ws("-", *[F.substring(digest, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def word(d: Draws) -> Column:
    return d.pick(WORDS, "word")


Provider = Callable[[Draws], Column]

# Every name a provider answers to.
_PROVIDERS: dict[str, Provider] = {
    "name": person, "full_name": person, "person": person,
    "email": email, "mail": email,
    "phone": phone, "tel": phone,
    "company": company, "org": company, "organization": company,
    "address": address, "street": address,
    "city": city,
    "country": country,
    "url": url,
    "uuid": uuid, "id": uuid, "guid": uuid,
    "word": word,
}


def register(name: str, provider: Provider) -> None:
    """Add or replace a provider."""
    _PROVIDERS[name.lower()] = provider


def provide(name: str, draws: Draws) -> Column:
    """Values of a provider; unknown names give person names."""
    return _PROVIDERS.get(name.lower(), person)(draws)


def known(name: str | None) -> bool:
    return bool(name) and name.lower() in _PROVIDERS
