"""Named vocabularies: each method builds a column from draws of one row. All lists here are our own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from seedloom.errors import GenerationError
from seedloom.functions.draw import Draw

FIRST = "Ada Alma Anton Bela Boris Carla Cesar Dana Dario Edda Emil Fay Felix Greta Hugo Ida Ilja Jana Jonas Kira Lena Leo Mara Milo Nora Otto Paula Quin Rosa Samir Tara Theo Uma Vera Willem Xenia Yara Zeno".split()
LAST = "Abt Baum Cruz Dahl Ebner Falk Grau Hahn Illner Jost Kern Lang Moll Nagel Oster Pohl Quast Reuter Stahl Thoma Ulm Vogt Weiss Ximen Young Zorn Almeida Brandt Costa Duarte Ferrer Gomes Herrera Ito Jensen Khan Larsen Moreau Novak Okafor".split()
LEVELS, AREAS, ROLES = "Junior Senior Lead Principal Chief Associate".split(), "Sales Data Product Quality Support Finance Network Logistics".split(), "Analyst Engineer Manager Planner Specialist Consultant Designer Clerk".split()
CITIES = "Ashford Birkenau Castello Dunmore Eastvale Fernhill Grenton Harwick Ilmenau Jarrow Kelso Lindau Marston Norden Oakley Porto Quedlin Rosston Selby Tilburg Ulster Varna Westport Yarmouth Zell".split()
#: Countries with their codes, which belong together.
COUNTRIES = [("Austria", "AT"), ("Belgium", "BE"), ("Brazil", "BR"), ("Canada", "CA"), ("Chile", "CL"), ("Denmark", "DK"), ("Finland", "FI"), ("France", "FR"), ("Germany", "DE"), ("Greece", "GR"), ("India", "IN"), ("Ireland", "IE"), ("Italy", "IT"), ("Japan", "JP"), ("Kenya", "KE"), ("Mexico", "MX"), ("Norway", "NO"), ("Poland", "PL"), ("Portugal", "PT"), ("Spain", "ES"), ("Sweden", "SE"), ("Turkey", "TR"), ("United States", "US"), ("Vietnam", "VN")]
STATES = "Alta Baja Cumbria Dorset Essex Fife Galway Holstein Istria Jura Kerry Lorraine Murcia Navarra Ontario Perm Quebec Rioja Saxony Tirol Umbria Vigo Wessex Zeeland".split()
STREETS, KINDS = "Oak Mill Station Garden River Church Market School Forest Bridge Castle Harbour".split(), "Street Road Lane Avenue Way Square".split()
TLDS, WORDS = "com org net".split(), "amber basin cedar delta ember fable grove haven inlet jetty knoll linen maple north ocean prism quill ridge stone tidal umber vivid willow yield zephyr".split()
FORMS, ADJECTIVES = "Ltd Inc Group GmbH Partners Works".split(), "Sturdy Compact Modern Rustic Light Smooth Classic Handy Quiet Bright".split()
MATERIALS, NOUNS = "Steel Wooden Cotton Rubber Granite Plastic Leather Glass".split(), "Chair Lamp Table Bag Shirt Clock Bottle Keyboard Bike Basket".split()
VERBS = "Balanced Adaptive Shared Open Managed Robust Secure Seamless".split()
DEPARTMENTS, COLORS = "Books Garden Music Sports Toys Tools Health Grocery Outdoors Office".split(), "red blue green amber black white teal olive coral ivory plum grey".split()
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud".split()
CURRENCIES, ACCOUNTS = "AUD BRL CAD CHF CNY CZK DKK EUR GBP HUF INR JPY KRW MXN NOK NZD PLN SEK TRY USD ZAR".split(), "Checking Savings Investment Loan Credit Trust Payroll Deposit".split()
MAKERS, MODELS = "Alfa Borgward Dacia Fiat Honda Lada Mazda Opel Rover Saab Skoda Toyota Volvo".split(), "Astra Corsa Delta Fabia Golf Jazz Leon Mondeo Note Octavia Punto Swift Yaris".split()


def pick(d: Draw, values: list[str], slot: int | Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (d.below(len(values), slot) + 1).cast("int"))


def joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def digits(d: Draw, n: int, slot: int) -> Column:
    """n decimal digits, of any length, by one draw for each twelve."""
    blocks = [F.lpad(d.below(10 ** min(12, n - k), slot + k).cast("string"), min(12, n - k), "0") for k in range(0, n, 12)]
    return F.concat(*blocks)


def words(d: Draw, low: int, high: int, slot: int) -> Column:
    n = (d.below(high - low + 1, slot) + low).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: pick(d, LOREM, k + slot * 1000)), " ")


def sentence(d: Draw, slot: int) -> Column:
    text = words(d, 4, 12, slot)
    return joined(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)), ".")


def ean13(d: Draw) -> Column:
    body = digits(d, 12, 1)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda a, k: a + F.substring(body, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 3).otherwise(1))
    return joined(body, F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string"))


def iban(d: Draw) -> Column:
    """DE with check digits by the remainder modulo 97 of 18 digits, the country as 1314, and 00."""
    body = digits(d, 18, 1)
    rest = F.pmod(joined(body, "131400").cast("decimal(24,0)"), F.lit(97).cast("decimal(24,0)")).cast("int")
    return joined("DE", F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), body)


def country(d: Draw, which: int) -> Column:
    return pick(d, [c[which] for c in COUNTRIES], 1)


def street(d: Draw) -> Column:
    return joined((d.below(200, 11) + 1).cast("string"), " ", pick(d, STREETS, 12), " ", pick(d, KINDS, 13))


def coordinate(d: Draw, limit: int) -> Column:
    return F.round(d.unit(1) * (2 * limit) - limit, 4)


def domain(d: Draw) -> Column:
    return joined(pick(d, WORDS, 21), pick(d, WORDS, 22), ".", pick(d, TLDS, 23))


def user(d: Draw) -> Column:
    return joined(F.lower(pick(d, FIRST, 1)), ".", F.lower(pick(d, LAST, 2)), d.below(1000, 3).cast("string"))


METHODS: dict[str, Callable[[Draw], Column]] = {
    "name.firstName": lambda d: pick(d, FIRST, 1), "name.lastName": lambda d: pick(d, LAST, 2), "name.fullName": lambda d: joined(pick(d, FIRST, 1), " ", pick(d, LAST, 2)),
    "name.jobTitle": lambda d: joined(pick(d, LEVELS, 1), " ", pick(d, AREAS, 2), " ", pick(d, ROLES, 3)),
    "internet.email": lambda d: joined(user(d), "@example.test"), "internet.userName": user, "internet.url": lambda d: joined("https://", domain(d), "/", pick(d, WORDS, 24)),
    "internet.ip": lambda d: F.concat_ws(".", *[d.below(256, k).cast("string") for k in range(4)]), "internet.domainName": domain,
    "phone.phoneNumber": lambda d: joined("(", digits(d, 3, 1), ") ", digits(d, 3, 20), "-", digits(d, 4, 40)),
    "address.city": lambda d: pick(d, CITIES, 1), "address.country": lambda d: country(d, 0), "address.countryCode": lambda d: country(d, 1), "address.state": lambda d: pick(d, STATES, 1),
    "address.zipCode": lambda d: digits(d, 5, 1), "address.streetAddress": street, "address.fullAddress": lambda d: joined(street(d), ", ", pick(d, CITIES, 1), ", ", pick(d, STATES, 2)),
    "address.latitude": lambda d: coordinate(d, 90), "address.longitude": lambda d: coordinate(d, 180),
    "company.companyName": lambda d: joined(pick(d, LAST, 1), " ", pick(d, FORMS, 2)), "company.catchPhrase": lambda d: joined(pick(d, VERBS, 1), " ", F.lower(pick(d, AREAS, 2)), " ", pick(d, WORDS, 3)),
    "commerce.productName": lambda d: joined(pick(d, ADJECTIVES, 1), " ", pick(d, MATERIALS, 2), " ", pick(d, NOUNS, 3)), "commerce.department": lambda d: pick(d, DEPARTMENTS, 1),
    "commerce.color": lambda d: pick(d, COLORS, 1), "commerce.ean13": ean13,
    "lorem.word": lambda d: pick(d, LOREM, 1), "lorem.sentence": lambda d: sentence(d, 1), "lorem.paragraph": lambda d: F.concat_ws(" ", *[sentence(d, k) for k in range(1, 5)]),
    "finance.iban": iban, "finance.currencyCode": lambda d: pick(d, CURRENCIES, 1), "finance.accountName": lambda d: joined(pick(d, ACCOUNTS, 1), " Account"),
    "vehicle.manufacturer": lambda d: pick(d, MAKERS, 1), "vehicle.model": lambda d: pick(d, MODELS, 1),
    "vehicle.vin": lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(17)), lambda k: pick(d, list("ABCDEFGHJKLMNPRSTUVWXYZ0123456789"), k)), ""),
}


def resolve(name: str) -> Callable[[Draw], Column]:
    for key, method in METHODS.items():
        if key.lower() == name.lower():
            return method
    raise GenerationError(f"unknown faker method {name!r}; known: {', '.join(sorted(METHODS))}")
