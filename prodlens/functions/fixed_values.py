"""Word lists, patterns and weights that results depend on. They are fixed values of the data model, not logic."""

# Calls to action and filler that cleaning removes, in order of precedence.
MARKETING_PHRASES = [
    "buy online", "buy now", "shop now", "shop online", "buy online or instore", "buy online or in-store",
    "order now", "order online", "order today", "add to cart", "add to basket", "add to bag",
    "free shipping", "free delivery", "fast delivery", "limited time offer", "limited stock", "while stocks last",
    "sale ends", "hurry", "don't miss out",
    "upgrade your", "transform your", "elevate your", "perfect for everyday use", "perfect for any occasion",
    "great for everyday", "ideal for everyday", "a must-have", "must have", "essential for",
    "best in class", "world class", "top quality", "premium quality", "superior quality", "exceptional quality",
    "unbeatable value", "amazing value", "great value", "customer favorite", "best seller", "top rated",
    "as seen on", "featured in", "recommended by",
    "introducing the", "meet the", "discover the", "experience the", "enjoy the", "love the",
    "the ultimate", "the perfect", "the best", "designed for you", "made for you", "built for you",
    "you'll love", "you will love", "you're going to love", "what's included", "what you get", "package includes",
    "click here", "learn more", "find out more", "see details", "view details", "more info",
    "terms and conditions apply", "t&cs apply", "subject to availability", "while supplies last",
    "please contact us", "contact customer service", "for more information", "for assistance",
    "warranty information", "return policy", "satisfaction guaranteed", "money back guarantee",
]

# Units that stay in cleaned text though they may be single characters.
UNITS = [
    "w", "watt", "watts", "kw", "mw", "v", "volt", "volts", "kv", "mv", "a", "amp", "amps", "ma", "hz", "khz", "mhz", "ghz",
    "l", "litre", "liter", "litres", "liters", "ml", "cl", "kg", "g", "gram", "grams", "mg", "lb", "lbs", "oz",
    "mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "db", "decibel", "decibels", "rpm", "psi", "bar",
    "gb", "mb", "kb", "tb", "%", "percent", "percentage", "°c", "°f", "celsius", "fahrenheit",
    "min", "mins", "minute", "minutes", "sec", "secs", "second", "seconds", "hr", "hrs", "hour", "hours",
]

# Words that make no phrase by themselves.
GENERIC_WORDS = [
    "product", "products", "item", "items", "feature", "features", "includes", "including", "included", "include",
    "provides", "providing", "provided", "provide", "offers", "offering", "offered", "offer", "available", "availability",
    "new", "latest", "model", "version", "series", "use", "uses", "using", "used", "make", "makes", "making", "made",
    "help", "helps", "helping", "helped", "allow", "allows", "allowing", "allowed", "enable", "enables", "enabling", "enabled",
    "ensure", "ensures", "ensuring", "ensured", "also", "just", "even", "really", "very", "well",
    "like", "way", "thing", "things", "lot", "lots", "need", "needs", "want", "wants",
    "come", "comes", "coming", "came", "get", "gets", "getting", "got", "see", "look", "looks", "looking",
    "know", "knows", "knowing", "known",
]

# Stop words of the frequency fallback.
FALLBACK_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must",
    "shall", "can", "this", "that", "these", "those", "it", "its", "as", "if", "when", "than", "so", "no", "not", "only", "same",
    "such", "too", "very", "just", "also", "now", "here", "there", "where", "which", "who", "what", "all", "each", "every",
    "both", "few", "more", "most", "other", "some", "any", "nor", "own", "out", "up", "down", "off", "over", "under", "again",
    "further", "then", "once", "your", "our", "their", "we", "you", "he", "she", "they", "i", "me", "him", "her", "us", "them",
]

# Default of a parameter: English stop words dropped before n-grams are made. Any list can be given instead.
STOP_WORDS = sorted({*FALLBACK_STOP_WORDS, "about", "above", "across", "after", "against", "along", "among", "around", "because", "before", "below", "between", "beyond", "during", "into", "through", "until", "upon", "within", "without", "how", "why", "whom", "whose", "while", "mine", "yours", "ours", "theirs", "his", "hers", "myself", "yourself", "himself", "herself", "itself", "ourselves", "themselves", "am", "cannot", "else", "ever", "never", "yet", "still", "though", "whether", "my"})

# Words stripped from the edges of noun phrases.
EDGE_WORDS = [
    "the", "a", "an", "this", "that", "these", "those", "its", "their", "our", "your", "my", "his", "her",
    "some", "any", "all", "each", "every", "both", "few", "more", "most", "other", "another", "such", "no",
    "many", "much", "several", "various", "certain", "new", "old", "good", "great", "best", "better",
    "first", "last", "next", "previous", "same", "different",
]

# Words that often stand before nouns, and endings of technical nouns.
ADJECTIVES = [
    "digital", "automatic", "electric", "electronic", "wireless", "compact", "portable", "adjustable", "removable", "built-in",
    "stainless", "steel", "glass", "plastic", "metal", "aluminum", "led", "lcd", "touch", "smart", "high", "low", "fast", "slow",
    "large", "small", "medium", "mini", "micro", "dual", "triple", "multi", "single", "double", "full", "half", "auto", "manual",
    "front", "back", "side", "top", "bottom", "inner", "outer", "easy", "quick", "safe", "secure", "quiet", "silent", "powerful",
]
NOUN_SUFFIXES = ["tion", "sion", "ment", "ness", "ity", "ance", "ence", "er", "or", "ist", "ism", "ing", "age", "ure", "ry", "ty", "al", "ics", "ogy", "logy"]

# Words that say nothing about whether a text is about its title.
RELEVANCE_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been",
    "this", "that", "it", "its", "as", "if", "not", "no", "so", "up", "out",
]

# Headings that announce a description, words that hint at one, and signs of challenge and error pages.
HEADING_KEYWORDS = [
    "description", "desc", "describe", "about", "what is", "details", "detail", "information", "info", "learn more",
    "overview", "summary", "introduction", "intro", "features", "feature", "key features", "highlights", "main features", "product features",
    "specifications", "specs", "specification", "technical", "tech specs", "product", "item", "article",
]
CONTAINER_WORDS = ["product", "item", "details", "description"]
CHALLENGE_PHRASES = ["access denied", "checking your browser", "just a moment", "please enable javascript to continue"]
ERROR_PHRASES = [
    "access denied", "you don't have permission", "you do not have permission", "403 forbidden", "404 not found", "page not found",
    "error 403", "error 404", "error 500", "internal server error", "service unavailable", "temporarily unavailable",
    "access to this page has been denied", "permission denied", "unauthorized access", "blocked", "captcha", "verify you are human",
    "cloudflare", "ray id", "please enable cookies", "enable javascript", "browser check",
]

# Classes and headings of sections about other products, and where descriptions stand.
OTHER_PRODUCT_CLASSES = [
    "related", "similar", "recommend", "also-bought", "also-viewed", "you-may-like", "customers-also", "frequently-bought", "compare",
    "alternatives", "other-products", "more-products", "product-list", "product-grid", "product-carousel", "product-slider", "cross-sell",
    "upsell", "bundle", "accessories", "suggestions", "popular", "trending", "best-seller", "new-arrival", "featured-products", "shop-more",
    "browse-more", "explore-more", "recently-viewed", "viewed-products",
]
OTHER_PRODUCT_HEADINGS = [
    "related products", "similar products", "you may also like", "customers also bought", "frequently bought together", "compare similar",
    "other customers", "more from", "shop similar", "recommended for you", "people also viewed", "similar items", "complete the look",
    "goes well with", "pair it with", "shop the collection", "more to explore", "recently viewed", "your browsing history", "inspired by",
]
DESCRIPTION_SELECTORS = [
    "[data-product-description]", "[data-description]", ".product-description", ".product-details", ".product-info", ".pdp-description",
    ".pdp-details", ".pdp-info", "#product-description", "#description", "#product-details", ".ProductDescription", ".ProductDetails",
    ".product__description", '[itemprop="description"]', ".woocommerce-product-details__short-description", ".product-single__description",
]
BLOCK_SELECTORS = [
    "article", "main", "section", '[role="main"]', ".product-description", ".product-details", "#product-description", "#description",
    ".product-content", ".product-body", ".item-description",
]
NAVIGATION_CLASSES = ["nav", "footer", "header", "breadcrumb", "menu", "sidebar"]
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6", "summary", "button", "span", "div", "label", "strong", "p"]
SCRIPT_PATTERNS = [
    r"window\.themeConfig\(['\"]product['\"],\s*({.+?})\);", r"var\s+product\s*=\s*({.+?});", r"window\.product\s*=\s*({.+?});",
    r"window\.productData\s*=\s*({.+?});", r"__INITIAL_STATE__\s*=\s*({.+?});",
]
SCRIPT_KEYS = ["description", "content", "body_html", "details", "productDescription"]
METHOD_CONFIDENCE = {"jsonld": 0.95, "javascript": 0.90, "semantic_section": 0.85, "meta_fallback": 0.60, "best_block": 0.50}

# Entity types, those whose absence is critical, and entity limits.
ENTITY_TYPES = ["capacity", "care", "certification", "dimension", "environment", "finish", "material", "rating", "standard", "warranty", "weight"]
CRITICAL_TYPES = ["dimension", "material"]

# Patterns of measured entities (over lower-cased text); the value is the first group and the unit the second.
NUMBER = r"(\d+(?:\.\d+)?)"
DIMENSION_PATTERNS = [
    NUMBER + r"\s*(mm|cm|m)\s*[x×]\s*\d+(?:\.\d+)?\s*(?:mm|cm|m)\s*[x×]\s*\d+(?:\.\d+)?\s*(?:mm|cm|m)",
    NUMBER + r'\s*(mm|cm|m|inch|inches|")\s*(?:w|h|d|l|width|height|depth|length|diameter|dia)?',
    r"(?:width|height|depth|length|diameter|dia)[:\s]*" + NUMBER + r'\s*(mm|cm|m|inch|inches|")',
]
WEIGHT_PATTERNS = [NUMBER + r"\s*(kg|g|lb|lbs|pounds?)", r"(?:weight|weighs?)[:\s]*" + NUMBER + r"\s*(kg|g|lb|lbs|pounds?)"]
CAPACITY_PATTERNS = [NUMBER + r"\s*(l|litre|liter|litres|liters|ml|gallon|gal)", r"(?:capacity|volume)[:\s]*" + NUMBER + r"\s*(l|litre|liter|ml)"]
POWER_PATTERNS = [NUMBER + r"\s*(w|kw|watts?|kilowatts?)", NUMBER + r"\s*(v|volts?)", NUMBER + r"\s*(a|amps?|amperes?)", NUMBER + r"\s*(mj/?h?)"]
STANDARD_PATTERNS = [
    r"(as/nzs\s*\d+(?:\.\d+)?)", r"(as\s*\d+(?:\.\d+)?)", r"(nzs\s*\d+(?:\.\d+)?)", r"(iso\s*\d+(?:[-:]\d+)?)",
    r"(iec\s*\d+)", r"(en\s*\d+)", r"(ul\s*\d+)", r"(ip\d{2})", r"(ipx\d)",
]
CARE_PATTERNS = [
    r"(\d+)\s*(?:year|yr)s?\s*(?:warranty|guarantee)", r"(?:warranty|guarantee)[:\s]*(\d+)\s*(?:year|yr)s?", r"(lifetime)\s*(?:warranty|guarantee)",
    r"(wipe\s*clean)", r"(machine\s*wash)", r"(hand\s*wash)", r"(dry\s*clean)", r"(spot\s*clean)",
]

# Names matched as whole words only, contexts in which a name is a care instruction, and signs of textiles.
WHOLE_WORD_MATERIALS = ["ash", "tin", "oak", "gel", "ice"]
CARE_CONTEXTS = {
    "iron": [
        "cool iron", "warm iron", "hot iron", "steam iron", "no iron", "do not iron", "iron reverse", "reverse iron", "iron inside",
        "iron on reverse", "iron low", "iron medium", "iron high", "iron setting", "softener iron", "softener cool iron",
        "iron reverse dry", "line dry iron", "tumble dry iron", "dry clean iron",
    ],
    "ash": ["wash", "machine wash", "hand wash", "cold wash", "warm wash"],
}
TEXTILE_IMPOSSIBLE = [
    "stainless steel", "steel", "iron", "aluminium", "aluminum", "brass", "copper", "bronze", "granite", "marble", "concrete", "glass",
    "ceramic", "porcelain", "timber", "oak", "pine", "teak", "ash", "walnut", "maple", "birch", "mahogany", "chrome", "nickel", "zinc",
    "tin", "lead", "pewter", "cast iron",
]
TEXTILE_SIGNS = [
    "shirt", "shorts", "pants", "dress", "jacket", "coat", "sweater", "hoodie", "skirt", "legging", "top", "bottom", "swim",
    "swimwear", "swimsuit", "bikini", "trunks", "underwear", "bra", "sock", "apparel", "clothing", "wear", "garment", "fabric",
    "cotton", "polyester", "nylon", "spandex", "lycra", "elastic", "waistband", "drawstring", "pocket", "seam", "hem", "sleeve", "collar",
]
COMPOUNDS = {"microwave": ["microwave safe", "microwave friendly", "microwave proof", "microwave-safe"]}

# Keywords that count three times.
SPECIFIC_KEYWORDS = [
    "pocky", "chocolate", "candy", "snack", "biscuit", "cookie", "confectionery", "gummy", "wafer", "chips", "crackers", "marshmallow",
    "lolly", "lollies", "cup", "cups", "mug", "mugs", "tumbler", "goblet", "drinkware", "glassware", "shirt", "dress", "jacket", "pants",
    "jeans", "hoodie", "sweater", "swimwear", "swimsuit", "bikini", "trunks", "boardshorts", "rashie", "shoe", "boot", "sneaker", "sandal",
    "cooktop", "refrigerator", "dishwasher", "oven", "laptop", "phone", "tablet", "television", "camera",
]

# Categories in order of precedence, each with its keywords.
CATEGORIES = {
    "Food": [
        "food", "snack", "snacks", "candy", "candies", "chocolate", "biscuit", "biscuits", "cookie", "cookies", "confectionery", "confection",
        "treat", "treats", "sweet", "sweets", "lolly", "lollies", "pocky", "chips", "crisps", "crackers", "cracker", "wafer", "wafers", "gummy",
        "gummies", "caramel", "toffee", "fudge", "mints", "mint", "licorice", "liquorice", "marshmallow", "nougat", "praline", "truffle", "bonbon",
        "jellybean", "lollipop", "hard candy", "chewy", "crunchy", "crispy", "edible", "flavour", "flavor", "strawberry", "matcha", "vanilla",
        "cocoa", "hazelnut",
    ],
    "Drinkware": [
        "cup", "cups", "mug", "mugs", "glass", "glasses", "tumbler", "tumblers", "drinkware", "goblet", "goblets", "wine glass", "champagne flute",
        "beer glass", "coffee cup", "tea cup", "espresso cup", "travel mug", "sippy cup", "shot glass", "highball", "lowball", "pint glass",
        "stemware", "glassware",
    ],
    "Apparel": [
        "apparel", "clothing", "clothes", "wear", "shirt", "short", "shorts", "pants", "dress", "jacket", "coat", "sweater", "hoodie", "tank top",
        "blouse top", "crop top", "bottom", "skirt", "legging", "leggings", "bike short", "bike shorts", "activewear", "sportswear", "athleisure",
        "underwear", "bra", "sock", "socks", "swimwear", "swimsuit", "swim short", "swim shorts", "swim trunk", "swim trunks", "board short",
        "board shorts", "bikini", "rashie", "rash guard", "wetsuit", "trunks", "briefs", "boxer", "boxers",
    ],
    "Footwear": [
        "footwear", "shoe", "shoes", "boot", "boots", "sneaker", "sneakers", "sandal", "sandals", "slipper", "slippers", "heel", "heels",
        "loafer", "loafers", "trainer", "trainers",
    ],
    "Accessories": [
        "accessory", "accessories", "bag", "bags", "handbag", "purse", "wallet", "belt", "hat", "cap", "scarf", "glove", "gloves", "watch",
        "jewelry", "jewellery", "sunglasses",
    ],
    "Furniture": ["furniture", "table", "chair", "sofa", "bed", "cabinet", "desk", "shelving", "bench", "stool", "ottoman"],
    "Appliance": [
        "appliance", "cooktop", "stove", "oven", "cooker", "rangehood", "hood", "dishwasher", "refrigerator", "freezer", "microwave oven",
        "microwave appliance",
    ],
    "Cookware": ["cookware", "pan", "pot", "skillet", "wok", "stock pot", "saucepan", "frypan", "bakeware"],
    "Flooring": ["flooring", "floor", "tile", "laminate", "vinyl", "carpet", "rug", "timber floor"],
    "Textile": ["textile", "fabric", "cloth", "curtain", "bedding", "cushion", "throw", "blanket", "pillow"],
    "Hardware": ["hardware", "handle", "lock", "hinge", "fastener", "bolt", "knob", "pull", "tap", "faucet"],
    "Lighting": ["light", "lighting", "lamp", "bulb", "fixture", "pendant", "chandelier", "sconce", "downlight"],
    "Outdoor": ["outdoor", "patio", "garden", "landscape", "bbq", "barbecue", "umbrella", "gazebo"],
    "Storage": ["storage", "shelf", "rack", "organizer", "basket", "container", "box", "bin"],
    "Decor": ["decor", "decoration", "art", "mirror", "vase", "frame", "ornament", "sculpture"],
    "Electronics": [
        "electronic", "electronics", "computer", "laptop", "phone", "tablet", "tv", "television", "speaker", "headphone", "headphones", "camera",
    ],
    "Sports": ["sports", "sport", "fitness", "gym", "exercise", "workout", "yoga", "cycling", "running", "swimming"],
}

# Materials that a product of a category is not made of.
EXCLUDED_MATERIALS = {
    "Food": [
        "stainless steel", "steel", "iron", "aluminium", "aluminum", "brass", "copper", "bronze", "granite", "marble", "concrete", "glass",
        "ceramic", "porcelain", "timber", "oak", "pine", "teak", "ash", "walnut", "leather", "polyester", "nylon", "cotton", "wool", "silk",
        "linen", "velvet", "suede", "denim", "lycra", "spandex", "acrylic", "vinyl", "rubber",
    ],
    "Drinkware": [
        "steel", "iron", "aluminium", "aluminum", "brass", "copper", "bronze", "granite", "marble", "concrete", "timber", "oak", "pine", "teak",
        "ash", "walnut", "leather", "polyester", "nylon", "cotton", "wool", "silk", "linen", "velvet", "suede", "denim", "lycra", "spandex",
        "vinyl", "rubber",
    ],
    "Apparel": [
        "stainless steel", "steel", "iron", "aluminium", "aluminum", "brass", "copper", "bronze", "granite", "marble", "concrete", "glass",
        "ceramic", "porcelain", "timber", "oak", "pine", "teak", "ash", "walnut", "maple", "birch", "mahogany", "chrome", "nickel", "zinc",
    ],
    "Footwear": [
        "stainless steel", "steel", "iron", "aluminium", "aluminum", "brass", "copper", "bronze", "granite", "marble", "concrete", "glass",
        "ceramic", "porcelain", "timber", "oak", "pine", "teak", "ash",
    ],
    "Accessories": ["stainless steel", "iron", "aluminium", "granite", "marble", "concrete", "timber", "oak", "pine", "teak", "ash"],
    "Sports": [
        "stainless steel", "steel", "iron", "granite", "marble", "concrete", "glass", "porcelain", "timber", "oak", "pine", "teak", "ash",
        "walnut", "maple",
    ],
}

# Defaults of parameters: dictionaries (category, name, aliases[, description]) in order of precedence.
MATERIALS = [
    ("metal", "stainless steel", ["304 stainless", "316 stainless"]), ("metal", "steel", []), ("metal", "brass", []), ("metal", "copper", []), ("metal", "nickel", []),
    ("metal", "tin", []), ("metal", "iron", []), ("metal", "aluminium", ["aluminum"]), ("wood", "teak", ["teak wood"]), ("wood", "oak", []), ("wood", "ash", []), ("textile", "cotton", []), ("textile", "linen", []),
]
FINISHES = [("metal", "brushed", []), ("metal", "polished", ["mirror polished"]), ("metal", "anodised", ["anodized"]), ("metal", "plated", []), ("metal", "burnished", []), ("paint", "powder coated", ["powder-coated"]), ("paint", "matte", ["matt"])]
ENVIRONMENTS = [("place", "outdoor", ["patio", "outdoors"], "For use outside."), ("place", "indoor", ["indoors"], "For use inside."), ("place", "coastal", ["salt air", "marine"], "Withstands salt air.")]

# Name variants, applied in order; the first that fits is replaced.
NAME_VARIANTS = [
    ("aluminum", "aluminium"), ("ss", "stainless steel"), ("304 stainless", "stainless steel"), ("316 stainless", "stainless steel"), ("alu", "aluminium"),
    ("powder-coated", "powder coated"), ("powdercoated", "powder coated"), ("anodized", "anodised"), ("galvanized", "galvanised"), ("matt", "matte"),
    ("indoors", "indoor"), ("outdoors", "outdoor"), ("exterior", "outdoor"), ("interior", "indoor"),
]

# Where each type of entity goes on a page.
PLACEMENTS = {
    "material": ["specs_table", "features", "care_instructions"], "dimension": ["specs_table", "hero_copy"], "weight": ["specs_table", "shipping_info"],
    "capacity": ["specs_table", "features"], "finish": ["specs_table", "care_instructions"], "standard": ["specs_table", "certifications", "faq"],
    "certification": ["specs_table", "certifications", "sustainability"], "environment": ["designed_for", "use_cases", "features"],
    "care": ["care_instructions", "maintenance", "faq"], "warranty": ["warranty_info", "faq", "specs_table"], "rating": ["specs_table", "features"],
}

# Why an entity of each type matters, and why it is placed where it is.
REASONS = {
    "dimension": "Product dimensions affect fit and suitability for intended space.",
    "weight": "Weight affects portability and structural requirements.",
    "capacity": "Capacity determines how much the product can hold.",
    "rating": "Power rating indicates energy consumption and performance.",
    "material": "Material composition affects durability, maintenance, and appearance.",
    "finish": "Finish affects appearance, durability, and maintenance.",
    "standard": "Compliance ensures product meets safety and quality standards.",
    "certification": "Compliance ensures product meets safety and quality standards.",
    "care": "Care instructions help maintain product quality and lifespan.",
    "warranty": "Warranty coverage provides peace of mind and protection.",
}
PLACEMENT_REASONS = {
    "material": "Material information belongs in specifications and care guidance.",
    "dimension": "Dimensions are key specifications that help with fit assessment.",
    "weight": "Weight affects shipping and handling considerations.",
    "capacity": "Capacity is a key functional specification.",
    "finish": "Finish affects appearance and maintenance requirements.",
    "standard": "Standards/certifications should be clearly listed.",
    "certification": "Certifications provide credibility and compliance info.",
    "environment": "Usage environment guides customer suitability assessment.",
    "care": "Care information helps maintain product longevity.",
    "warranty": "Warranty details provide purchase confidence.",
    "rating": "Power/efficiency ratings are key specifications.",
}
OTHER_PLACEMENT_REASON = "Appropriate PDP section based on entity type."
# Placements of whole groups of terms: group, name, type, sections, reason.
GROUP_PLACEMENTS = [
    ("Core Attributes", "Specifications", "core_attributes", ["specs_table"], "Core attribute terms should populate the specifications table."),
    ("Functional Terms", "Features & Benefits", "functional_terms", ["features", "hero_copy"], "Functional advantages highlight key benefits."),
    ("Usage Context", "Designed For", "usage_context", ["designed_for", "use_cases"], "Usage context helps customers assess suitability."),
]
# Placements in the plain format of results: sections and reason by type, the reason of other types, and those of groups.
PLAIN_PLACEMENTS = {
    "material": (["specs_table", "features", "care_instructions"], "Material information belongs in specifications and care guidance."),
    "standard": (["specs_table", "certifications", "faq"], "Certifications should be clearly listed."),
    "environment": (["designed_for", "use_cases", "features"], "Usage environment guides suitability assessment."),
    "care": (["care_instructions", "maintenance", "faq"], "Care information helps maintain product longevity."),
}
PLAIN_PLACEMENT_REASON = "Appropriate PDP section."
PLAIN_GROUP_PLACEMENTS = [
    ("Core Attributes", "Specifications", "core_attributes", ["specs_table"], "Core attributes populate specifications."),
    ("Functional Terms", "Features & Benefits", "functional_terms", ["features", "hero_copy"], "Functional terms highlight benefits."),
]
# Sections of a model's answer, and the names that results give them.
ANSWER_SECTIONS = {
    "specs_table": "spec_table", "features": "designed_for", "designed_for": "designed_for", "not_suitable_for": "not_suitable_for",
    "care_instructions": "care_maintenance", "faqs": "faqs", "json_ld": "json_ld",
}
# Names that the fields of a request's terms go by, in order of precedence.
TERM_FIELDS = {
    "phrase": ["phrase", "term"], "tfidf_score": ["tfidf_score", "score"], "doc_freq": ["doc_freq", "docFreq"],
    "importance_score": ["importance_score", "importanceScore"], "source": ["source"],
}
# Methods that a structured scrape reports.
SCRAPE_METHODS = {"ok": "firecrawl", "failed": "firecrawl_error", "refused": "firecrawl_api_error"}

# Patterns that tidy a text after brands are taken out, applied in order with what each becomes.
BRAND_TIDYING = [(r"\s+", " "), (r"^[\s\-,]+|[\s\-,]+$", ""), (r"\s*[,\-]\s*[,\-]\s*", " ")]
