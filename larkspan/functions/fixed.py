"""Word lists, patterns and tables that results depend on, in their given order. Patterns are matched without regard to case.

Alias tables of skills, soft skills, actions and objects are not here: they are tables of the user's, passed as DataFrames."""

#: (pattern, grade): the first found counts.
GRADES = [
    (r"\b(?:intern|trainee|incubat|стаж[её]р|стажировк)\b", "Intern"),
    (r"\b(?:junior|jun|beginner|entry.level|entrylevel)\b", "Junior"),
    (r"\b(?:junior[\s\-/+]*middle|middle[\s\-/+]*junior)\b", "Junior/Middle"),
    (r"\b(?:middle|mid)(?:\W|$|[\s\-/+]*senior|[\s\-/+]*junior)\b", "Middle"),
    (r"\b(?:middle[\s\-/+]*senior|senior[\s\-/+]*middle)\b", "Middle/Senior"),
    (r"\b(?:senior|старший)\b", "Senior"),
    (r"\b(?:lead|head|principal|chief|главный)\b", "Lead"),
    (r"\b(?:руководител.?.?|director|manager|head\s+of)\b", "Lead"),
]
#: (pattern, grade) for a lower-cased title without a description: the first found counts.
TITLE_GRADES = [
    (r"\bintern\b|\bстажер|\binternship\b|\bjunior\b.*\bdevops|\bстаж", "Intern"),
    (r"\bjunior\b|\bджуниор|\bджу н|\bмладш", "Junior"),
    (r"\bsenior\b|\bсиньор|\bсеньор|\bстарш", "Senior"),
    (r"\blead\b|\bлид\b|\bhead of\b|\bруководител", "Lead"),
    (r"\bmiddle\b|\bмидл\b", "Middle"),
    (r"\b(middle|mid)\s*[/-]\s*(senior|sr)\b", "Middle/Senior"),
]
#: (words, class): the first class with a word that a title contains counts.
TITLE_CLASSES = [
    (["Junior", "Trainee", "Intern", "Internship", "Младший", "Стажер"], "junior"),
    (["Senior", "Lead", "Team Lead", "Head", "Architect", "Principal", "Старший", "Ведущий", "Руководитель", "Архитектор"], "senior"),
    (["Middle", "Middle+", "Strong Middle"], "middle"),
]
#: Patterns of positions, and the names of what they match.
POSITIONS = [
    r"site.reliability.engineer|(?<=[\s(/])sre|^sre",
    r"mlops",
    r"devsecops",
    r"(?<=[\s(/])devops|^devops|[\s(/]devops|[|-]devops",
    r"platform.engineer|platform.eng",
    r"system.admin|sysadmin|системный.администратор|системный.админ",
    r"system.engineer|системный.инженер",
    r"infrastructure.engineer|infra.engineer",
    r"cloud.engineer|cloud.architect",
    r"network.engineer|сетевой",
    r"data.engineer",
    r"security.engineer",
]
POSITION_NAMES = {
    "devops": "DevOps",
    "devsecops": "DevSecOps",
    "mlops": "MLOps",
    "site reliability engineer": "SRE",
    "sre": "SRE",
    "platform engineer": "Platform Engineer",
    "platform eng": "Platform Engineer",
    "system administrator": "System Administrator",
    "sysadmin": "System Administrator",
    "системный администратор": "System Administrator",
    "системный админ": "System Administrator",
    "system engineer": "System Engineer",
    "системный инженер": "System Engineer",
    "infrastructure engineer": "Infrastructure Engineer",
    "infra engineer": "Infrastructure Engineer",
    "cloud engineer": "Cloud Engineer",
    "cloud architect": "Cloud Architect",
    "network engineer": "Network Engineer",
    "сетевой": "Network Engineer",
    "data engineer": "Data Engineer",
    "security engineer": "Security Engineer",
}
#: (pattern, exception or None) of titles that are not relevant.
IRRELEVANT = [
    (r"\b(frontend|front-end|front end|фронтенд)\b", None),
    (r"\b(ios|android|mobile|flutter|react native)\b", None),
    (r"\bdata scientist\b", None),
    (r"\b(qa|тестировщик|test engineer|auto.?test)\b", None),
    (r"\b(designer|ux|ui|дизайнер)\b", None),
    (r"\b(product manager|project manager|hr|recruiter|менеджер\s+проекта)\b", None),
    (r"\b(backend|back-end|back end)", r"\b(devops|sre|mlops)\b"),
    (r"\b1с\b", r"\b(devops|администрирование|инфраструктур)\b"),
    (r"\b(helpdesk|help desk|техподдержка|support engineer)\b", r"\b(sre|devops)\b"),
]
IRRELEVANT_REASON, SHORT_REASON = "non-devops title", "short description"
#: (pattern, key) of section headers; the noise keys.
SECTIONS = [
    (r"Обязанност[ия]\s*:", "responsibilities"),
    (r"Чем\s+предстоит\s+заниматься\s*:", "responsibilities"),
    (r"Основные\s+задачи\s*:", "responsibilities"),
    (r"Вам\s+предстоит\s*:", "responsibilities"),
    (r"Задачи\s*:", "responsibilities"),
    (r"Требовани[ейя]\s*:", "requirements"),
    (r"(?:Наши\s+)?(?:Ожидания\s+от\s+кандидат|Что\s+мы\s+ожидаем|Что\s+для\s+нас\s+важно|Мы\s+ожидаем)\s*:", "requirements"),
    (r"(?:Необходимые?\s+(?:навыки|знания|опыт)|Что\s+нам\s+важно)\s*:", "requirements"),
    (r"Будет\s+плюсом\s*:", "preferred"),
    (r"Будет\s+преимуществом\s*:", "preferred"),
    (r"Плюсом\s+будет\s*:", "preferred"),
    (r"(?:Желательно|Приветствуется)\s*:", "preferred"),
    (r"(?:Nice\s+to\s+have|Good\s+to\s+have|Preferred)\s*:", "preferred"),
    (r"Опыт\s+работы\s*:", "experience"),
    (r"Ключевые\s+навыки\s*:", "key_skills"),
    (r"(?:Технические\s+)?(?:Стек|Stack|Tech\s+stack)\s*:", "key_skills"),
    (r"Мы\s+предлагаем\s*:", "noise_benefits"),
    (r"Условия\s*:", "noise_conditions"),
    (r"О\s+компании(?:\s+и\s+команде|\s*:|\s|\Z)", "noise_company"),
    (r"О\s+проекте\s*:", "noise_project"),
    (r"Преимущества\s*:", "noise_benefits"),
    (r"Почему\s+стоит\s+выбрать\s+нас\s*:", "noise_benefits"),
]
NOISE = ["noise_benefits", "noise_conditions", "noise_company", "noise_project"]
#: Labels of channel messages that are dropped before a colon; tags that exclude a message, and of which it needs one.
MESSAGE_LABELS = r"Публикатор|Обсуждение|Резюме\s+отправлять|Отклик|Писать|Контакты?"
EXCLUDING_TAGS, NEEDED_TAGS = ["#резюме", "#resume"], ["#vacancy", "#вакансия"]
#: Codes of the first way to convert pay: aliases, (pattern, code) of texts, rates where there is no table, patterns of yearly and hourly pay.
CODE_ALIASES = {"RUR": "RUB", "USDT": "USD", "SO'M": "UZS", "СУМ": "UZS", "SO`M": "UZS"}
CODE_PATTERNS = [
    (r"\$\s*\d|usd|доллар", "USD"),
    (r"€|eur|евро", "EUR"),
    (r"so'?m|сум[а-я]*\b", "UZS"),
    (r"тенге|₸|kzt", "KZT"),
    (r"дирхам|aed", "AED"),
    (r"usdt|usdc", "USDT"),
]
FALLBACK_RATES = [("USD", 85.0), ("EUR", 92.0), ("AED", 23.0), ("BYN", 27.0), ("KZT", 0.17), ("UZS", 0.0061), ("USDT", 85.0)]
ANNUAL = r"/\s*years?\b|/\s*yrs?\b|per\s+annum"
HOURLY = r"(?:почасов|hourly|\d[\d\s]*(?:\(.*?\))?\s*(?:руб\.?|₽|\$|€|USD|EUR|KZT)\s*(?:/|за|в)\s*(?:час|hour|hr))"
#: Codes of the second way: names, mentions beside an amount, places.
CODE_NAMES = {
    "rub": "RUB", "rur": "RUB", "руб": "RUB", "рублей": "RUB",
    "usd": "USD", "usd.": "USD", "долл": "USD", "долларов": "USD", "$": "USD",
    "eur": "EUR", "euro": "EUR", "евро": "EUR", "€": "EUR",
    "kzt": "KZT", "тенге": "KZT", "тг": "KZT",
    "gbp": "GBP", "фунт": "GBP", "£": "GBP",
    "cny": "CNY", "юань": "CNY", "¥": "CNY",
    "try": "TRY", "lira": "TRY", "tl": "TRY", "лир": "TRY",
    "uah": "UAH", "гривна": "UAH", "₴": "UAH",
    "byn": "BYN", "бел": "BYN", "br": "BYN",
    "uzs": "UZS", "сум": "UZS",
    "gel": "GEL", "лари": "GEL",
    "amd": "AMD", "драм": "AMD",
    "azn": "AZN", "манат": "AZN",
}
MENTIONED = r"[\d\s]+\s*(?:usd|eur|rub|kzt|gbp|cny|try|uah|byn|uzs|gel|amd|azn|\$|€|£|¥|₴|тг|руб|долл|евро|тенге|фунт|юань|лир|гривна|бел|сум|лари|драм|манат)|(?:\$|€|£|¥)\s*[\d\s]+"
PLACES = [
    (["москва", "россия", "санкт-петербург", "казань", "новосибирск"], "RUB"),
    (["алматы", "астана", "нур-султан", "казахстан"], "KZT"),
    (["минск", "беларусь"], "BYN"),
    (["ташкент", "узбекистан"], "UZS"),
    (["тбилиси", "грузия"], "GEL"),
]
#: Compound names that are not split; words that mark remote work.
PROTECTED = ["ci/cd", "ci cd", "ci-cd", "tcp/ip", "tcp ip", "tcp-ip", "ssl/tls", "ssl tls", "dns/dhcp", "it", "it-инфраструктура", "sla/slo", "sla-slo", "ha/dr", "ha-dr", "sl/sli", "sl-sli"]
REMOTE = "удалённ|remote"
