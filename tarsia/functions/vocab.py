"""Vocabularies. Results depend on these words and on their order."""

# canonical keys
KEY_REPLACEMENTS = (("second generation", "2"), ("2nd gen", "2"), ("2ª generazione", "2"), ("seconda generazione", "2"), ("usb-c", "usbc"), ("usb c", "usbc"), ("playstation", "ps"))
KEY_FILLERS = ("apple", "sony", "samsung", "microsoft", "nintendo", "nuovo", "new", "originale", "offerta", "promo", "spedizione", "gratis", "garanzia", "cuffie", "auricolari", "wireless", "bluetooth")

# questions
CATEGORIES = {
    "tv": ("tv", "smart tv", "televisore", "televisori", "oled", "qled"),
    "cuffie": ("cuffie", "cuffia", "auricolari", "auricolare", "airpods", "earbuds", "headphone"),
    "smartphone": ("smartphone", "telefono", "telefoni", "cellulare", "cellulari", "iphone", "samsung", "galaxy", "xiaomi", "oppo", "motorola", "honor"),
    "laptop": ("laptop", "notebook", "portatile", "portatili", "macbook", "ultrabook"),
    "casse_audio": ("casse", "cassa", "speaker", "altoparlanti", "altoparlante", "bluetooth", "jbl"),
    "desktop": ("desktop", "pc fisso", "computer fisso", "all in one", "aio"),
    "gaming": ("gaming", "ps5", "playstation", "xbox", "nintendo", "switch"),
}
CATEGORY_FALLBACKS = {"gaming": ("tech", "gaming")}
BRANDS = {
    "apple": ("apple", "airpods", "iphone", "ipad", "macbook"),
    "samsung": ("samsung", "galaxy"),
    "sony": ("sony", "playstation", "ps5"),
    "microsoft": ("microsoft", "xbox"),
    "nintendo": ("nintendo", "switch"),
    "xiaomi": ("xiaomi", "redmi", "poco"),
    "oppo": ("oppo",),
    "motorola": ("motorola", "moto"),
    "honor": ("honor",),
    "jbl": ("jbl",),
    "lg": ("lg",),
    "hp": ("hp",),
    "lenovo": ("lenovo",),
    "asus": ("asus",),
    "acer": ("acer",),
}
SYNONYMS = {
    "ps5": ("ps5", "playstation", "playstation 5"),
    "playstation": ("ps5", "playstation", "playstation 5"),
    "airpods": ("airpods", "auricolari", "cuffie"),
    "iphone": ("iphone", "apple"),
    "galaxy": ("galaxy", "samsung"),
    "tv": ("tv", "televisore", "smart tv"),
    "televisore": ("tv", "televisore", "smart tv"),
    "cuffie": ("cuffie", "auricolari", "headphone"),
    "auricolari": ("cuffie", "auricolari", "earbuds"),
    "laptop": ("laptop", "notebook", "portatile"),
    "notebook": ("laptop", "notebook", "portatile"),
    "portatile": ("laptop", "notebook", "portatile"),
    "casse": ("casse", "speaker", "altoparlanti"),
    "speaker": ("casse", "speaker", "altoparlanti"),
}
PRODUCT_BRANDS = ("airpods", "apple", "iphone", "ipad", "macbook", "playstation", "ps5", "xbox", "nintendo", "switch", "galaxy", "samsung", "xiaomi", "oppo", "motorola", "honor", "sony", "jbl", "lg", "hp", "lenovo", "asus", "acer", "redmi", "poco")
SINGLE_PRODUCTS = ("airpods", "iphone", "ipad", "macbook", "ps5", "playstation", "xbox", "nintendo")
PRODUCT_PHRASES = ("airpods max", "airpods pro", "iphone 15", "iphone 16", "iphone 15 pro", "iphone 16 pro", "lg oled", "jbl speaker", "jbl bluetooth", "playstation 5", "samsung galaxy")
MODELS = ("max", "pro", "mini", "plus", "ultra", "oled", "qled", "qned", "ps5", "m1", "m2", "m3", "m4", "15", "16")
NEEDS = {
    "wireless": ("wireless", "bluetooth", "senza fili", "tws"),
    "anc": ("anc", "cancellazione rumore", "noise cancelling"),
    "sport": ("palestra", "sport", "corsa", "allenamento", "impermeabile"),
    "work": ("lavoro", "ufficio", "produttivita", "smart working"),
    "student": ("universita", "studio", "scuola", "studenti"),
    "gaming": ("gaming", "ps5", "playstation", "xbox", "nintendo"),
    "tv_ps5": ("tv per ps5", "televisore per ps5", "hdmi 2 1", "120hz"),
    "portable": ("portatile", "leggero", "mobilita"),
    "cheap": ("economico", "economica", "economici", "economiche", "budget"),
}
SORTS = {
    "discount": ("sconto", "scontato", "scontata", "ribasso", "risparmio"),
    "lowest_price": ("costa meno", "prezzo basso", "piu economico", "economico", "sotto", "budget"),
    "best_value": ("miglior", "migliore", "migliori", "buono", "buona", "consigli", "consiglia"),
    "timing": ("quando", "conviene", "aspettare", "previsione"),
}
GENERIC = ("bluetooth", "wireless", "cuffie", "cuffia", "auricolari", "auricolare", "smartphone", "telefono", "cellulare", "tv", "smart", "televisore", "laptop", "notebook", "portatile", "casse", "speaker", "audio")
#: Aliases that don't make a product belong to a category.
WEAK_ALIASES = (*PRODUCT_BRANDS, "bluetooth", "wireless", "smart", "gaming")
STOPWORDS = (
    "a", "ad", "al", "alla", "allo", "anche", "che", "chi", "cosa", "costa", "costano", "costi", "comprare", "conviene", "con", "da", "del", "della", "delle", "di", "dove", "economiche", "economici", "economico", "entro", "euro",
    "gli", "ha", "i", "il", "in", "la", "le", "lo", "massimo", "meno", "miglior", "migliore", "migliori", "offerta", "offerte", "per", "piu", "prezzo", "prodotto", "prodotti", "quale", "quando", "sotto", "su", "tech", "un", "una",
)
COLOURS = ("argento", "azzurro", "beige", "bianco", "black", "blu", "blue", "grafite", "gray", "green", "grigio", "nero", "oro", "pink", "red", "rosa", "rosso", "silver", "verde", "white")
INTENTS = {
    "discount_ranking": ("sconto", "scontato", "scontata", "risparmio", "ribasso"),
    "when_to_buy": ("quando", "conviene comprare", "comprare ora", "aspettare", "aspetto", "previsione", "prezzo scende", "prezzo scendera"),
    "cheapest_offer": ("costa meno", "dove costa", "prezzo piu basso", "prezzo migliore", "miglior prezzo", "miglior offerta", "migliore offerta", "meno caro", "piu economico"),
}
RECOMMEND = ("migliori", "miglior", "buono", "buona", "consigli", "consiglia", "cerco", "lavoro", "economiche", "economici")
SEARCH = ("cerca", "trova", "mostrami", "offerte", "prodotti")

# quality gates: aliases in order, the first whole token wins
GATE_CATEGORIES = {
    "smartphone": "smartphone", "smartphones": "smartphone", "telefono": "smartphone", "telefoni": "smartphone", "cellulare": "smartphone", "cellulari": "smartphone", "iphone": "smartphone", "samsung galaxy": "smartphone", "xiaomi": "smartphone",
    "cuffie": "cuffie", "cuffia": "cuffie", "auricolari": "cuffie", "auricolare": "cuffie", "headphones": "cuffie", "earbuds": "cuffie", "audio": "cuffie", "speaker": "cuffie", "casse": "cuffie", "casse_audio": "cuffie",
    "tv": "tv", "smart tv": "tv", "smart_tv": "tv", "televisore": "tv", "televisori": "tv", "home cinema": "tv",
    "gaming": "gaming", "console": "gaming", "ps5": "gaming", "ps4": "gaming", "playstation": "gaming", "xbox": "gaming", "nintendo": "gaming", "switch": "gaming",
    "controller": "gaming_accessori", "headset gaming": "gaming_accessori", "accessori gaming": "gaming_accessori", "gaming_accessori": "gaming_accessori", "dock": "gaming_accessori",
    "laptop": "laptop", "notebook": "laptop", "portatile": "laptop", "desktop": "laptop", "pc": "laptop", "computer": "laptop",
}
GATE_CAUTIOUS = ("laptop",)
GATE_GENERIC = ("accessorio", "audio", "auricolari", "bluetooth", "casse", "cellulare", "computer", "cuffie", "gaming", "laptop", "notebook", "pc", "prodotto", "smartphone", "speaker", "telefono", "televisore", "tv", "wireless")
GATE_NOISE = ("black friday", "garanzia", "gratis", "nuovo", "offerta", "online", "promo", "promozione", "sconto", "spedizione")
GATE_BRANDS = ("acer", "apple", "asus", "beats", "bose", "hp", "jbl", "lenovo", "lg", "microsoft", "motorola", "nintendo", "oppo", "philips", "samsung", "sony", "xiaomi")
GATE_FAMILIES = ("airpods", "bravia", "galaxy", "iphone", "ipad", "macbook", "playstation", "ps5", "switch", "xbox")
GATE_VARIANTS = ("air", "classic", "digital", "disc", "edge", "lite", "max", "mini", "plus", "pro", "slim", "ultra")
GATE_BUNDLES = ("bundle", "kit", "pack", "refurbished", "renewed", "ricondizionato", "usato")
GATE_COLOURS = ("argento", "black", "blu", "blue", "grafite", "gray", "green", "grigio", "nero", "oro", "red", "rosa", "rosso", "silver", "verde", "white")

# matching
MATCH_BRANDS = ("acer", "amazon", "apple", "asus", "beats", "bose", "canon", "dyson", "garmin", "google", "hisense", "honor", "hp", "huawei", "jbl", "lenovo", "lg", "logitech", "microsoft", "motorola", "nintendo", "nothing", "oneplus", "oppo", "panasonic", "philips", "playstation", "realme", "samsung", "sennheiser", "sharp", "sony", "tcl", "xiaomi", "yamaha")
MATCH_FAMILIES = ("airpods", "bravia", "galaxy", "iphone", "ipad", "imac", "macbook", "pixel", "playstation", "ps5", "ps4", "switch", "watch", "xbox")
MATCH_NOISE = (
    "a", "ad", "al", "alla", "anche", "audio", "auricolari", "bluetooth", "cavo", "cellulare", "cm", "computer", "con", "cuffia", "cuffie", "da", "del", "della", "di", "e", "edition", "garanzia", "il", "in",
    "la", "le", "lo", "memoria", "new", "notebook", "nuovo", "offerta", "originale", "pc", "per", "portatile", "promo", "smart", "smartphone", "spedizione", "telefono", "televisore", "tv", "wireless",
)
MATCH_VARIANTS = ("air", "classic", "digital", "disc", "edge", "lite", "max", "mini", "oled", "plus", "pro", "qled", "se", "slim", "ultra")
MATCH_BUNDLES = ("bundle", "kit", "pack", "set")
MATCH_CONDITIONS = ("refurbished", "renewed", "ricondizionato", "usato")
MATCH_NOT_MODELS = ("5g", "4g", "4k", "8k", "dvbt2", "full", "hdr10", "hz", "mah", "main10", "s2", "uhd", "wi", "wifi")

# budgets in a question, the first that matches
BUDGETS = (r"(?:sotto|massimo|entro|budget)\s+(?:i\s+)?(\d{2,5})", r"meno\s+di\s+(\d{2,5})", r"(\d{2,5})\s*(?:euro|eur)")

# answers
CATEGORY_LABELS = {"tv": "TV", "cuffie": "cuffie", "smartphone": "smartphone", "laptop": "laptop", "casse_audio": "casse audio", "desktop": "desktop", "gaming": "prodotti gaming"}
TOKEN_LABELS = {"airpods": "AirPods", "iphone": "iPhone", "ipad": "iPad", "macbook": "MacBook", "ps5": "PS5", "playstation": "PlayStation", "xbox": "Xbox", "nintendo": "Nintendo"}
NO_PRICE, NO_NAME = "prezzo non disponibile", "Prodotto senza nome"
AVAILABLE_CATEGORIES = "TV, cuffie, smartphone, laptop e casse audio"
FOLLOW_UP = 'Puoi chiedermi anche: "cuffie sotto 100€" oppure "quando comprare questo prodotto?"'
NOT_UNDERSTOOD = 'Non ho capito bene la domanda.\nCategorie disponibili: {categories}.\nProva con: "tv sotto i 500 euro", "dove costa meno AirPods" o "quale prodotto ha lo sconto migliore".'
NO_PRODUCTS = 'Non ho trovato prodotti reali{hint} per "{query}".\nCategorie disponibili: {categories}.\nProva con marca, modello o budget. Non invento prezzi o retailer.\n{follow_up}'
SPECIFIC = ("Ho trovato questo prodotto tra quelli tracciati, ma non ho offerte valide al momento.", "Ho trovato questo prodotto tra quelli tracciati.", "Ho trovato questi prodotti tra quelli tracciati.")
NO_OFFERS = "Ho trovato prodotti coerenti, ma non offerte valide al momento.\n{follow_up}"
DISCOUNTS = "Migliori sconti reali trovati.\nLe card mostrano solo offerte con sconto calcolabile."
UNDER_BUDGET = "Ho trovato {n} opzioni sotto {budget}.\nLe card sono ordinate per rilevanza, prezzo e qualita del dato."
IN_CATEGORY = "Ho trovato {n} risultati per {category}.\nLe card sono ordinate per rilevanza e valore reale."
FOUND = "Ho trovato {n} prodotti rilevanti.\nLe card mostrano le migliori offerte reali disponibili."
ONE_STORE, SEVERAL_STORES, FEW_PRODUCTS = "Confronto limitato: al momento ho dati utilizzabili solo da {store}.", "Confronto basato su {n} store.", "Campione piccolo: potrebbero mancare alternative nel database."
THIN_HISTORY, REAL_DATA = "Storico prezzi ancora limitato: non considero affidabile una previsione.", "Dati: uso solo prodotti, offerte e storico reali presenti nel catalogo."
TOO_LITTLE_HISTORY = "Non ho ancora abbastanza storico per dire quando conviene comprare {product}.{best}\n{note} Punti storico validi: {points}.\n{follow_up}"
BEST_NOW = " Prezzo attuale migliore: {store} a {price}."
NO_FORECAST = "Non ho ancora una previsione affidabile per {product}.\nHo {points} punti storici complessivi, ma non abbastanza storico affidabile sullo store della miglior offerta.\n{follow_up}"
FORECAST = "Per {product}: {recommendation}.\nMiglior prezzo attuale: {store} a {price}.\nPerche: {reason}\n{note} Storico={points} punti, min={low}, media={mean}, confidence={confidence}.\n{follow_up}"
REASONS = {
    "low": "Prezzo corrente vicino al minimo storico o sotto la media storica.",
    "high": "Prezzo corrente sopra la media e lontano dal minimo storico.",
    "falling": "Trend recente in calo: conviene monitorare prima di comprare.",
    "plain": "Prezzo non estremo rispetto allo storico disponibile.",
}
CONCISE = {"discount_ranking": "Migliori sconti reali trovati", "when_to_buy": "Prezzo e storico disponibili", "cheapest_offer": "Prezzo piu basso trovato"}
CONCISE_ELSE, CONCISE_SUMMARY = "{category}{budget}: {n} opzioni reali", "Le card sotto usano solo prodotti e offerte reali presenti nel catalogo."
