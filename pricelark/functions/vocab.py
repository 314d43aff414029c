"""Words, patterns and codes that results depend on.

Patterns are Java's, with flags ``i`` (case), ``u`` and ``U`` (Unicode case, words and
boundaries).
"""

# --- fixed values ---------------------------------------------------------------------

STOP_WORDS = (
    "для", "від", "до", "та", "і", "в", "на", "з", "по", "the", "for", "and",
    "шт", "уп", "грн", "оригінал", "новий", "нова", "нове",
)

#: Groups of opposite sides; each side is a tuple of word beginnings.
SIDES = (
    (("лів", "лев"), ("прав",)),
    (("перед",), ("задн",)),
    (("верхн",), ("нижн",)),
)

USED = (
    r"б\s*[/\\.\-]\s*[ув]", r"\bбу\b", r"\bбв\b",
    r"вживан\w*", r"уживан\w*", r"потриман\w*",
    r"бывш\w*", r"использованн\w*",
    r"авторозборк\w*", r"авторазборк\w*", r"розборк\w*", r"разборк\w*",
    r"\bрозбір\b", r"\bразбор\b", r"\bдонор\w*",
    r"під\s+відновлен\w*", r"под\s+восстановлен\w*",
    r"відновлен\w*", r"восстановлен\w*",
    r"після\s+дтп", r"после\s+дтп", r"контрактн\w*",
    r"\bsecond\s*hand\b", r"\bсеконд[\s-]?хенд\b", r"\bused\b",
)

ON_REQUEST = (
    r"цін[аи]\s+(за|по)\s+(запитом|запиту|запросу)", r"цена\s+по\s+запросу",
    r"уточнюйте\s+цін\w*", r"уточняйте\s+цен\w*", r"уточнити\s+цін\w*",
    r"цін[аи]\s+при\s+звернен\w*", r"договірн\w*", r"договорн\w*",
    r"за\s+домовленіст\w*", r"по\s+договоренност\w*",
    r"\bдзвоніть\b", r"\bтелефонуйте\b", r"\bзвоните\b", r"price\s+on\s+request",
)

#: What counts in a stock note, where a call for details isn't about the price.
ON_REQUEST_STOCK = (
    r"цін[аи]\s+(за|по)\s+(запитом|запиту|запросу)", r"цена\s+по\s+запросу",
    r"уточнюйте\s+цін\w*", r"уточняйте\s+цен\w*",
    r"цін[аи]\s+при\s+звернен\w*", r"договірн\w*", r"договорн\w*",
)

NEW = (r"\bнов[аеийоыіїя]\w*", r"\bnew\b")

STOCK_CODES = {
    "avail": "in_stock",
    "available": "in_stock",
    "not_avail": "out_of_stock",
    "not_available": "out_of_stock",
    "unavailable": "out_of_stock",
    "waiting_for_supply": "on_order",
    "order": "on_order",
}

OUT_OF_STOCK = (
    r"\bне(?:ма(?:є)?)?\s+в\s+наявності\b", r"\bне(?:т)?\s+в\s+наличии\b", r"\bзакінчився\b",
    r"\bнема(?:є)?\s+на\s+складі\b", r"\bнет\s+на\s+складе\b", r"\bтовара\s+нет\b",
    r"\bвідсутн\w*", r"\bотсутств\w*", r"\bнедоступн\w*", r"\bрозпродан\w*", r"\bраспродан\w*",
    r"\bзнято\s+з\s+продажу\b", r"\bпродано\b",
    r"\bout\s+of\s+stock\b", r"\bsold\s+out\b", r"\bunavailable\b",
)

ON_ORDER = (
    r"\bпід\s+замовлення\b", r"\bпод\s+заказ\b", r"\bочікується\b", r"\bожидается\b",
    r"\bпоставка\s+від\b", r"\bдоставка\s+з-за\s+кордону\b",
)

IN_STOCK = (
    r"\b(?:є\s+)?в\s+наявності\b", r"\bв\s+наличии\b", r"\bготовий\s+до\s+відправки\b",
    r"\bотправка\s+товара\s+(?:сегодня|завтра)\b", r"\bвідправка\s+товару\s+(?:сьогодні|завтра)\b",
    r"\bavailable\b", r"\bin\s+stock\b",
)

OUT_OF_STOCK_LABEL = "Немає в наявності"

CAR_NAMES = (
    "AUDI", "BMW", "MERCEDES(?:BENZ)?", "BAUREIHE", "VOLKSWAGEN", "VW", "OPEL", "FORD", "FIAT",
    "PEUGEOT", "CITROEN", "RENAULT", "CHEVROLET", "DAEWOO", "SKODA", "SEAT", "NISSAN", "TOYOTA",
    "HYUNDAI", "KIA", "MAZDA", "HONDA", "MITSUBISHI", "SUZUKI", "VOLVO", "IVECO",
    "SPRINTER", "VITO", "VIANO", "GOLF", "PASSAT", "TRANSIT", "ESCORT", "SIERRA", "MONDEO", "FOCUS",
    "KANGOO", "BERLINGO", "DUCATO", "DOBLO", "COMBO", "CADDY", "TRAFIC", "MASTER", "LANOS", "AVEO",
    "LACETTI", "NUBIRA", "LEGANZA", "MATIZ", "LOGAN", "MEGANE", "CLIO", "SCENIC", "LAGUNA",
)

OWN_BRANDS = ("kemp",)
OWN_DOMAINS = ("kemp.ua",)
OWN_SELLERS = (("2847093", "kemp"), ("4015921", "avtobust"), ("3325174", "profparts"), ("3912822", "parts-avto"))
COVERED_DOMAINS = ("prom.ua", "avto.pro", "exist.ua")
ALLOWED_TLD = ".ua"

CURRENCY_SYMBOLS = {"грн": "UAH", "$": "USD", "€": "EUR"}
HRYVNIA = ("", "ГРН", "ГРН.", "₴")

AMOUNT = r"(\d[\d\s ]{0,9}(?:[.,]\d{1,2})?)\s*(?:грн|₴|uah)"
INSTALMENT = AMOUNT + r"\s*(?:[xх×]\s*\d|/\s*м[іе]с)"

MONTHS = ("січня", "лютого", "березня", "квітня", "травня", "червня", "липня", "серпня", "вересня", "жовтня", "листопада", "грудня")

# --- numbers that decide ---------------------------------------------------------------

STRONG = 0.7  # confidence from which a price counts
UNVERIFIED = 0.5
OEM_HIT = 0.9
ANALOG = 0.75
SAME = 0.95
NAME_KEEP, NAME_STRONG = 0.7, 0.8
NAME_KEEP_SCORE, NAME_STRONG_SCORE = 0.55, 0.7
MIN_OEM = 6  # shorter codes occur in other titles by chance
SELF_SUFFICIENT_DIGITS = 8
STEM = 4
DISCOUNT = "0.94"
OUTLIER_FACTOR = 8
OUTLIER_MIN_OFFERS = 4
SUSPICIOUS = "2.5"
MIN_SAMPLE = 3
VERIFY_MOST = 40
PHOTO_CHEAPEST, PHOTO_MOST = 3, 4
SOURCE_MOST = {"prom": 60, "avtopro": 40, "google": 20, "exist": 20}
MAX_OEM_TERMS, MAX_NAME_TOKENS = 2, 8
FREE_CHECKS = 30
