"""Word lists, tables, constants and patterns that results depend on."""

# fixed values: white space as JavaScript's \s has it, spelled out for Java and RE2 alike
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)

# fixed values: token patterns
WORD = r"[A-Za-z][A-Za-z'’.-]*[A-Za-z]|[A-Za-z]"
CASED = r"[A-Za-z]+(?:'[A-Za-z]+)?|[.,!?;:]"
TERM = r"[a-zA-Z][a-zA-Z'-]{2,}"
BLOCK_WORD = r"[a-zA-Z][a-zA-Z'-]*"

# fixed values: markers, floors and constants of the model
SOS = "<s>"
FLOOR = 1e-9
GUARD = 1e-9
CACHE_GAMMA, CACHE_BOOST, CACHE_MIN = 0.15, 1.0, 2
ALPHA = 0.15
MILESTONES = (1_000, 5_000, 10_000, 25_000, 50_000, 100_000, 250_000, 500_000, 1_000_000)
CHARS_PER_MINUTE = 200

# fixed values: abbreviations that do not end a sentence
ABBREVIATIONS = (
    "e.g i.e etc vs cf al ca viz nb vol ed eds pp p fig figs no nos op cit ibid "
    "mr mrs ms dr prof sr jr st rev hon gen col capt lt sgt gov sen rep pres "
    "jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun "
    "inc ltd co corp dept est approx min max avg misc univ assn bros "
    "u.s u.k u.n a.m p.m e.u d.c w.r.t wrt a.k.a aka resp et.al e.t.c esp incl excl "
    "u.s.a a.d b.c b.c.e c.e ph.d b.a m.a b.sc m.sc"
).split()

# fixed values: the shorter list of the kernel's splitter
KERNEL_ABBREVIATIONS = (
    "e.g i.e etc vs mr mrs ms dr prof st u.s u.k u.n a.m p.m jan feb mar apr jun "
    "jul aug sep sept oct nov dec inc ltd co no fig vol cf al"
).split()

# fixed values: stop words of terms
STOP_WORDS = (
    "the a an and or but of to in on at for is it as by be we i you he she they this that with from "
    "was are not have has had will would can could should all one so if up out no do does did my me us "
    "your our their his her its them then than there here what when where which who how why into over such some "
    "more most other any each also just only very much many been being were am these those about after before because "
    "while between through during under again further once both get got make made like well even back still way may"
).split()

# fixed values: stop words of single-word link phrases
LINK_STOP_WORDS = (
    "the a an and or of to in on at for is it as by be we i you he she they this that with from "
    "was are but not have has had will can all one so if up out no do my me us"
).split()

# fixed values: stop words that keep their case in a phrase
PHRASE_STOP_WORDS = "the a an of and or for to in on at by with from as".split()

# fixed values: endings that join with an apostrophe
CLITICS = "s t d ll re ve m".split()

# fixed values: words that are never doubled on purpose
NEVER_DOUBLED = (
    "the a an and or nor but than then of to in on at for with from into onto as by "
    "is are was were be am it its we they this these those i"
).split()

# fixed values: word endings in the order in which they are tried
SUFFIXES = "ically iness ously ment ness ing ies ied ier iest ly es ed er est s".split()

# fixed values: words with their apostrophes restored
CONTRACTIONS = {
    "dont": "don't", "cant": "can't", "wont": "won't", "isnt": "isn't", "arent": "aren't", "wasnt": "wasn't",
    "werent": "weren't", "havent": "haven't", "hasnt": "hasn't", "hadnt": "hadn't", "doesnt": "doesn't",
    "didnt": "didn't", "couldnt": "couldn't", "wouldnt": "wouldn't", "shouldnt": "shouldn't", "mustnt": "mustn't",
    "neednt": "needn't", "im": "I'm", "ive": "I've", "youre": "you're", "youve": "you've", "youll": "you'll",
    "theyre": "they're", "theyve": "they've", "theyll": "they'll", "weve": "we've", "wouldve": "would've",
    "couldve": "could've", "shouldve": "should've", "thats": "that's", "whats": "what's", "hes": "he's",
    "shes": "she's", "whos": "who's", "wheres": "where's", "theres": "there's", "heres": "here's", "youd": "you'd",
    "theyd": "they'd", "whod": "who'd", "itd": "it'd", "thered": "there'd", "wholl": "who'll", "itll": "it'll",
}

# fixed values: sets of words that are taken for each other
CONFUSED = (
    ("their", "there", "theyre"), ("your", "youre"), ("its", "it's"), ("to", "too", "two"), ("form", "from"),
    ("then", "than"), ("affect", "effect"), ("accept", "except"), ("lose", "loose"), ("were", "where", "wear"),
    ("quiet", "quite"), ("of", "off"),
)

# fixed values: fractions and their glyphs
FRACTIONS = {
    "1/2": "½", "1/3": "⅓", "2/3": "⅔", "1/4": "¼", "3/4": "¾", "1/5": "⅕", "2/5": "⅖", "3/5": "⅗", "4/5": "⅘",
    "1/6": "⅙", "5/6": "⅚", "1/7": "⅐", "1/8": "⅛", "3/8": "⅜", "5/8": "⅝", "7/8": "⅞", "1/9": "⅑", "1/10": "⅒",
}

# fixed values: letters that folding spells out
SPECIAL_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "þ": "th"}

# fixed values: keyboard rows, their shift and the distance of an unknown key
LAYOUTS = {
    "qwerty": ("qwertyuiop", "asdfghjkl", "zxcvbnm"),
    "qwertz": ("qwertzuiop", "asdfghjkl", "yxcvbnm"),
    "azerty": ("azertyuiop", "qsdfghjklm", "wxcvbn"),
    "dvorak": ("pyfgcrl", "aoeuidhtns", "qjkxbmwvz"),
}
ROW_SHIFT = (0.0, 0.25, 0.75)
FAR_KEY = 3.0

# fixed values: words that the profanity filter blocks (a filter list, not content)
PROFANITY = (
    "aryans asshole bastard bawdy bestiality bint bitches blackamoor bondage boobs brainfuck brothel bugger bullshit "
    "chav clitoral cock coon coons cum cunnilingus cunt dike dominatrix dyke ejaculation erotic fag faggot fap fica "
    "flasher fondling fuck fucked fucking gonad gypsies gypsy hajji honky hooker horny incest jap kafir kike klan "
    "kraut lewdness lust masturbating masturbation mestizo milf nazi negro negroes negros nig nigga nigger niggers "
    "niggr nigra nigro nob nonce nude nudes orgasm orgasms orgy paki pedophile pedophilia perversion pimp pimps piss "
    "pissed pogrom polak poof poon porn porno pornographic pornography prick prostitute prostitution pussy putz queer "
    "queers rape raped rapes raping rapist retard retarded retards screwing sexting sexy shit shite shitty shota "
    "skinhead slag slut smut smuts sodomy softcore squaw threesome tit tits waffen whore whores wop wtf"
).split()

# fixed values: currency words by symbol, and by code; in the order in which prefixes are looked up
CURRENCY_SYMBOLS = {
    "$": "dollar dollars usd buck bucks cad aud nzd sgd hkd mxn peso pesos", "€": "euro euros eur",
    "£": "pound pounds gbp quid sterling", "¥": "yen jpy yuan cny rmb renminbi", "₹": "rupee rupees inr",
    "Fr": "franc francs chf", "₽": "ruble rubles rouble roubles rub", "₩": "won krw", "₺": "lira try",
    "R$": "real reais brl", "R": "rand zar", "kr": "krona kronor krone kroner sek nok dkk", "zł": "zloty zlotych pln",
    "฿": "baht thb", "₪": "shekel shekels ils", "₦": "naira ngn", "₱": "php", "₫": "dong vnd", "Rp": "rupiah idr",
    "RM": "ringgit myr", "₴": "hryvnia uah", "AED": "aed", "SAR": "sar", "QAR": "qar", "₿": "btc bitcoin",
}
CURRENCY_CODES = {
    "USD": "dollar dollars usd buck bucks", "CAD": "cad", "AUD": "aud", "NZD": "nzd", "SGD": "sgd", "HKD": "hkd",
    "MXN": "mxn peso pesos", "EUR": "euro euros eur", "GBP": "pound pounds gbp quid sterling", "JPY": "yen jpy",
    "CNY": "yuan cny rmb renminbi", "INR": "rupee rupees inr", "CHF": "franc francs chf",
    "RUB": "ruble rubles rouble roubles rub", "KRW": "won krw", "TRY": "lira try", "BRL": "real reais brl",
    "ZAR": "rand zar", "SEK": "krona kronor sek", "NOK": "krone nok", "DKK": "kroner dkk", "PLN": "zloty zlotych pln",
    "THB": "baht thb", "ILS": "shekel shekels ils", "NGN": "naira ngn", "PHP": "php", "VND": "dong vnd",
    "IDR": "rupiah idr", "MYR": "ringgit myr", "UAH": "hryvnia uah", "AED": "aed", "SAR": "sar", "QAR": "qar",
    "BTC": "btc bitcoin",
}
SYMBOL_CODES = {
    "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₽": "RUB", "₩": "KRW", "₺": "TRY", "₴": "UAH",
    "₪": "ILS", "₦": "NGN", "₱": "PHP", "₫": "VND", "฿": "THB", "₿": "BTC", "R$": "BRL", "Rp": "IDR", "RM": "MYR",
    "R": "ZAR", "kr": "SEK", "zł": "PLN", "Fr": "CHF",
}
SYMBOLS_AFTER = ("kr", "zł", "Fr", "₫", "₴", "₽", "AED", "SAR", "QAR")
FORMAT_SYMBOLS = ("R$", "$", "€", "£", "¥", "₹", "₽", "₩", "₺", "₴", "₪", "₦", "₱", "₫", "฿", "₿", "Rp", "RM")

# fixed values: percentiles of the background by sensitivity, and the weights of a related section's score
PERCENTILES = {1: 0.99, 2: 0.98, 3: 0.96, 4: 0.93, 5: 0.9}
SEMANTIC_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3
