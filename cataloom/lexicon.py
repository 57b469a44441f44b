"""The word lists, lookup tables and constants that the results depend on.

Every table here is data, not logic.  All functions that use one of them take it as a
parameter with the table below as the default, so a catalog with other words can bring
its own.
"""

# --- Fixed values: canonical attributes of schema 1 and their source keys -------------
ATTRIBUTE_KEYS = {
    "style": ["style", "design style", "style/pattern", "furniture style", "decor style", "design", "theme"],
    "primary_material": ["material", "primary material", "frame material", "top material", "base material",
                         "main material", "construction material"],
    "secondary_material": ["secondary material", "seat material", "cushion material", "upholstery material",
                           "fabric", "upholstery"],
    "color_family": ["color", "color family", "primary color", "finish color", "finish", "color/finish"],
    "room_type": ["room", "room type", "room use", "suitable room", "recommended room", "room recommendation"],
    "product_type": ["product type", "type", "category", "subcategory"],
    "assembly_required": ["assembly required", "assembly", "requires assembly", "assembly needed"],
}
CATEGORICAL = ["style", "primary_material", "secondary_material", "color_family", "product_type"]
SCHEMA1 = list(ATTRIBUTE_KEYS)
SCHEMA2 = ["primary_color", "secondary_color", "primary_material", "secondary_material", "style", "shape", "assembly"]
TRUE_WORDS = ["yes", "true", "1", "required"]
FALSE_WORDS = ["no", "false", "0", "not required", "none"]

# --- Fixed values: value groups of schema 2 (group order decides) ---------------------
COLOR_FAMILIES = {
    "white": ["white", "snow", "alabaster", "eggshell"],
    "cream": ["cream", "ivory", "off-white", "off white", "linen", "pearl", "bone", "ecru"],
    "black": ["black", "jet", "onyx", "ebony"],
    "dark_gray": ["charcoal", "graphite", "slate", "dark gray", "dark grey"],
    "gray": ["gray", "grey", "pewter"],
    "light_gray": ["light gray", "light grey", "ash", "heather", "smoke", "silver gray"],
    "dark_brown": ["espresso", "chocolate", "cocoa", "coffee", "umber", "dark brown"],
    "brown": ["brown", "walnut", "chestnut", "sienna", "saddle", "russet"],
    "light_brown": ["tan", "khaki", "camel", "fawn", "light brown"],
    "mahogany": ["mahogany", "cherry", "auburn"],
    "cognac": ["cognac", "amber", "cinnamon"],
    "beige": ["beige", "sand", "taupe", "mushroom", "parchment", "champagne", "buff", "latte"],
    "natural": ["natural", "oatmeal", "wheat"],
    "navy": ["navy", "midnight blue", "indigo", "dark blue"],
    "blue": ["blue", "royal blue", "cobalt", "sapphire", "denim", "cornflower"],
    "light_blue": ["sky blue", "baby blue", "powder blue", "cerulean", "periwinkle", "light blue"],
    "teal": ["teal", "turquoise", "aqua"],
    "green": ["green", "emerald", "forest", "hunter", "kelly", "jade", "fern"],
    "sage": ["sage", "olive", "moss", "pistachio", "mint", "seafoam", "light green"],
    "red": ["red", "scarlet", "crimson", "ruby", "brick", "cranberry", "garnet"],
    "burgundy": ["burgundy", "maroon", "wine", "oxblood"],
    "pink": ["pink", "blush", "rose", "salmon", "dusty rose", "hot pink", "raspberry"],
    "coral": ["coral", "fuchsia", "magenta", "mauve"],
    "orange": ["orange", "tangerine", "peach", "apricot"],
    "rust": ["rust", "terracotta", "burnt orange", "copper"],
    "yellow": ["yellow", "lemon", "canary", "sunflower"],
    "gold": ["gold", "mustard", "honey", "golden"],
    "purple": ["purple", "violet", "eggplant", "amethyst", "grape", "plum"],
    "lavender": ["lavender", "lilac", "orchid"],
    "silver": ["silver", "chrome", "platinum", "metallic silver", "brushed silver", "stainless", "nickel"],
    "gold_metal": ["brass", "bronze", "antique gold", "rose gold", "brushed gold"],
    "clear": ["clear", "transparent", "glass", "crystal"],
    "multi": ["multi", "multicolor", "multicolored", "rainbow", "assorted", "various"],
}
MATERIAL_GROUPS = {
    "light_wood": ["oak", "pine", "maple", "birch", "bamboo", "cedar", "rubberwood", "acacia", "ash wood", "beech",
                   "poplar", "light wood"],
    "dark_wood": ["walnut", "mahogany", "teak", "cherry wood", "rosewood", "ebony wood", "dark wood", "espresso wood"],
    "wood": ["wood", "solid wood", "hardwood", "solid + manufactured wood", "manufactured wood + solid wood"],
    "manufactured_wood": ["manufactured wood", "mdf", "particle board", "plywood", "engineered wood", "laminate",
                          "wood veneer"],
    "metal": ["metal", "steel", "aluminum", "stainless steel", "zinc", "chrome", "tin"],
    "iron": ["iron", "wrought iron", "cast iron"],
    "brass_metal": ["brass", "bronze", "copper"],
    "velvet": ["velvet"],
    "linen": ["linen", "cotton", "100 % cotton", "canvas", "tweed", "burlap", "muslin"],
    "microfiber": ["polyester", "microfiber / polyester", "microfiber", "chenille", "satin", "silk", "nylon fabric"],
    "leather": ["leather", "genuine leather", "top grain", "full grain"],
    "faux_leather": ["faux leather", "bonded leather", "pu leather", "vegan leather", "leatherette",
                     "faux leather/leatherette"],
    "plastic": ["plastic", "resin/plastic", "resin", "acrylic", "polycarbonate", "abs", "polypropylene", "pvc",
                "vinyl"],
    "glass": ["glass", "tempered glass", "frosted glass", "mirror glass", "crystal glass"],
    "ceramic": ["ceramic", "porcelain", "terracotta", "earthenware", "stoneware"],
    "stone": ["marble", "granite", "quartz", "stone", "concrete", "slate", "travertine", "limestone", "terrazzo"],
    "natural_fiber": ["wool", "jute", "sisal", "seagrass", "rattan", "wicker", "cane", "hemp", "raffia"],
    "foam": ["foam", "memory foam", "gel foam", "polyurethane foam"],
    "synthetics": ["synthetics", "synthetic", "olefin", "polypropylene fiber"],
}
SURFACE_MATERIALS = ["velvet", "linen", "microfiber", "leather", "faux_leather", "natural_fiber", "synthetics"]
FRAME_MATERIALS = ["wood", "light_wood", "dark_wood", "manufactured_wood", "metal", "iron", "brass_metal", "plastic",
                   "foam"]
SHAPE_GROUPS = {
    "rectangular": ["rectangular", "rectangle", "rect"],
    "square": ["square"],
    "round": ["round", "circle", "circular"],
    "oval": ["oval", "round/oval", "oblong"],
    "l-shaped": ["l-shaped", "l-shape", "l shape"],
    "u-shaped": ["u-shaped", "u-shape", "u shape"],
    "runner": ["runner"],
    "irregular": ["irregular", "novelty", "freeform", "organic"],
    "hexagon": ["hexagon", "hexagonal"],
}
SHAPE_INVALID = ["chair", "sofa", "couch", "loveseat", "sectional", "recliner", "futon", "settee", "chaise", "rocker",
                 "glider", "stool", "bench", "bed", "headboard", "crib", "bassinet", "dresser", "wardrobe", "armoire",
                 "nightstand", "chest", "bookcase", "cabinet", "vanity", "hutch", "sideboard", "buffet", "credenza",
                 "lamp", "chandelier", "sconce", "pendant", "lantern", "faucet", "toilet", "sink", "shower", "fan",
                 "heater", "air conditioner", "curtain", "drape", "blind", "shade"]
ASSEMBLY_GROUPS = {
    "full": ["full assembly needed", "full assembly", "full", "yes"],
    "partial": ["partial assembly", "partial", "light"],
    "none": ["none", "no", "no assembly"],
}
STYLE_GROUPS = {
    "modern": ["modern & contemporary", "modern", "contemporary", "minimalist"],
    "traditional": ["traditional", "classic"],
    "mid-century modern": ["mid-century modern", "mid century", "midcentury"],
    "farmhouse": ["farmhouse / country", "farmhouse", "country/cottage", "cottage / country", "modern farmhouse",
                  "country"],
    "rustic": ["rustic", "lodge", "cabin"],
    "industrial": ["industrial", "urban"],
    "coastal": ["coastal", "nautical", "beach", "tropical"],
    "glam": ["glam", "glamorous", "hollywood regency"],
    "bohemian": ["bohemian", "boho", "eclectic", "global inspired"],
    "transitional": ["transitional"],
    "scandinavian": ["scandinavian", "nordic"],
}
UPHOLSTERED_CLASSES = [
    "Accent Chairs", "Arm Chairs", "Armchairs", "Club Chairs", "Barrel Chairs", "Wingback Chairs", "Parsons Chairs",
    "Recliners", "Rocking Chairs", "Swivel Chairs", "Dining Chairs", "Side Chairs", "Sofas", "Couches", "Loveseats",
    "Sectional Sofas", "Sleeper Sofas", "Futons", "Settees", "Chaise Lounges", "Ottomans", "Poufs", "Benches",
    "Headboards", "Upholstered Beds", "Bar Stools", "Counter Stools"]
UPHOLSTERY_SIGNALS = ["upholster", "tufted", "cushion", "padded", "velvet", "linen seat", "chenille", "microfiber",
                      "fabric seat", "leather seat", "faux leather"]
# surface guessed from the name, first hit wins
NAME_SURFACES = [("leather", "leather"), ("faux leather", "faux_leather"), ("velvet", "velvet"), ("linen", "linen"),
                 ("upholster", "microfiber"), ("tufted", "microfiber"), ("cushion", "microfiber"),
                 ("padded", "microfiber"), ("fabric", "microfiber")]
SAFE_NAME_COLORS = ["white", "black", "gray", "grey", "brown", "blue", "green", "red", "pink", "orange", "yellow",
                    "purple", "beige", "navy", "teal", "burgundy", "silver", "charcoal", "cream", "ivory", "tan",
                    "gold", "espresso", "walnut", "mahogany", "coral", "lavender", "sage", "olive", "rust",
                    "turquoise", "indigo", "slate"]
COLOR_FEATURE_KEYS = ["color", "basecolor", "finishcolor", "dswoodtone"]
MATERIAL_FEATURE_KEYS = ["primarymaterial", "material", "framematerial", "topmaterial", "seatmaterial",
                         "fabricdetails", "upholsterymaterial", "additionalframematerialdetails", "legmaterial"]
SHAPE_FEATURE_KEYS = ["shape", "headboardshape", "topshape", "mirrorshape", "rugshape", "tableshape"]
ASSEMBLY_FEATURE_KEYS = ["levelofassembly", "adultassemblyrequired"]
STYLE_FEATURE_KEYS = ["style", "dsprimaryproductstyle"]

# --- Fixed values: keyword dictionaries of the simple extractor ------------------------
STYLE_KEYWORDS = {
    "mid-century modern": ["mid-century", "mid century", "mcm", "retro modern"],
    "contemporary": ["contemporary", "modern", "sleek", "minimalist"],
    "traditional": ["traditional", "classic", "timeless", "elegant"],
    "farmhouse": ["farmhouse", "country", "barn", "shiplap", "rustic charm"],
    "industrial": ["industrial", "factory", "loft", "pipe", "raw metal"],
    "scandinavian": ["scandinavian", "nordic", "scandi", "hygge"],
    "bohemian": ["bohemian", "boho", "eclectic", "gypsy", "macrame"],
    "coastal": ["coastal", "beach", "nautical", "ocean", "seaside"],
    "rustic": ["rustic", "reclaimed", "distressed", "weathered", "log"],
    "transitional": ["transitional", "blend", "updated classic"],
}
MATERIAL_KEYWORDS = {
    "solid wood": ["solid wood", "hardwood", "oak", "walnut", "maple", "cherry", "pine", "teak", "mahogany", "birch",
                   "acacia"],
    "engineered wood": ["engineered wood", "mdf", "particle board", "plywood", "laminate", "veneer"],
    "metal": ["metal", "steel", "iron", "aluminum", "brass", "copper", "chrome", "stainless"],
    "glass": ["glass", "tempered glass", "frosted glass", "crystal"],
    "fabric": ["fabric", "polyester", "cotton", "linen", "velvet", "microfiber", "tweed", "chenille"],
    "leather": ["leather", "genuine leather", "faux leather", "bonded leather", "pu leather", "vegan leather"],
    "ceramic": ["ceramic", "porcelain", "stoneware", "terracotta"],
    "plastic": ["plastic", "acrylic", "polypropylene", "resin", "abs"],
    "stone": ["stone", "marble", "granite", "slate", "quartz", "travertine"],
}
COLOR_KEYWORDS = {
    "brown": ["brown", "walnut", "espresso", "chocolate", "mocha", "tan", "chestnut", "umber", "coffee"],
    "gray": ["gray", "grey", "charcoal", "slate", "silver", "ash", "graphite", "pewter"],
    "white": ["white", "ivory", "cream", "off-white", "snow", "pearl", "alabaster"],
    "black": ["black", "ebony", "onyx", "jet", "midnight"],
    "blue": ["blue", "navy", "cobalt", "teal", "aqua", "turquoise", "denim", "sapphire", "indigo"],
    "green": ["green", "olive", "sage", "emerald", "forest", "mint", "hunter"],
    "beige": ["beige", "sand", "khaki", "oatmeal", "linen", "natural", "wheat"],
    "red": ["red", "burgundy", "maroon", "crimson", "ruby", "wine", "scarlet"],
}
ROOM_KEYWORDS = {
    "living room": ["living room", "family room", "lounge", "sitting room"],
    "bedroom": ["bedroom", "master bedroom", "guest room"],
    "dining room": ["dining room", "dining area", "eat-in"],
    "kitchen": ["kitchen", "kitchenette"],
    "bathroom": ["bathroom", "bath", "powder room"],
    "office": ["office", "study", "workspace", "home office"],
    "outdoor": ["outdoor", "patio", "deck", "garden", "balcony"],
    "entryway": ["entryway", "foyer", "mudroom", "hallway"],
}
ASSEMBLY_TRUE = ["assembly required", "requires assembly", "some assembly"]
ASSEMBLY_FALSE = ["no assembly", "fully assembled", "ready to use"]

# --- Fixed values: catalog preparation --------------------------------------------------
JUNK_LEVEL1 = ["Sale", "Protection Plans", "Shop Product Type", "Clips", "Cash Handling", "Display Cases",
               "Stages, Risers and Accessories", "Learning Resources", "Physical Education Equipment",
               "Partition & Panel Hardware Accessories", "Meeting & Collaborative Spaces", "Ergonomic Accessories",
               "Early Education", "Desk Parts", "Buffet Accessories"]
RICHNESS = {"primary_color": 2.0, "secondary_color": 0.5, "primary_material": 2.0, "secondary_material": 0.5,
            "style": 1.5, "shape": 1.0, "assembly": 0.5}
CLASS_TIERS = [("large", 100, 30), ("medium", 20, 50), ("small", 5, 999), ("tiny", 0, 999)]  # tier, min rows, cap
WOODLIKE = ["wood", "light_wood", "dark_wood", "manufactured_wood"]
FABRICLIKE = ["velvet", "linen", "microfiber", "leather", "faux_leather"]
TARGET_KEYS = ["color", "color family", "material", "primary material", "style", "room", "room type",
               "assembly required", "assembly", "shape"]
COVERAGE_TARGETS = ["color", "material", "style", "room", "assembly"]
SAMPLE_CAPS = [5, 10, 15, 25, 50]

# --- Fixed values: model output ----------------------------------------------------------
NONE_WORDS = ["none", "null", "n/a", ""]
MODEL_KEY_MAP = {"color_family": "color", "primary_material": "material", "secondary_material": "secondary_material",
                 "style": "style", "room_type": "room", "product_type": "type", "assembly_required": "assembly"}
MODEL_COLORS = {"grey": "gray", "off-white": "cream", "ivory": "cream", "tan": "beige", "espresso": "brown",
                "walnut": "brown", "chocolate": "brown", "navy": "navy", "charcoal": "gray", "slate": "gray",
                "graphite": "gray", "silver": "silver", "champagne": "gold", "bronze": "gold"}
MODEL_MATERIALS = {"faux leather": "leather", "pu leather": "leather", "bonded leather": "leather",
                   "solid wood": "wood", "engineered wood": "wood", "mdf": "wood", "plywood": "wood",
                   "particle board": "wood", "stainless steel": "steel", "wrought iron": "iron", "cast iron": "iron",
                   "cast aluminum": "aluminum", "microfiber": "polyester", "chenille": "fabric", "tweed": "fabric",
                   "canvas": "cotton"}
MODEL_STYLES = {"mid century": "mid-century modern", "mid-century": "mid-century modern", "mcm": "mid-century modern",
                "scandi": "scandinavian", "boho": "bohemian", "country": "farmhouse",
                "modern farmhouse": "farmhouse", "retro": "mid-century modern", "minimalist": "modern",
                "classic": "traditional"}
COLOR_ALIASES = {"grey": "gray", "beige": "beige", "off-white": "white", "cream": "white", "tan": "brown",
                 "espresso": "brown", "walnut": "brown", "navy": "blue", "charcoal": "gray"}
STYLE_ALIASES = {"mid century": "mid-century modern", "mid-century": "mid-century modern", "scandi": "scandinavian",
                 "boho": "bohemian", "country": "farmhouse", "modern farmhouse": "farmhouse"}
PROMPT_HEAD = "Analyze this product image and provide:"
PROMPT_TAIL = "\nRespond in JSON format with the requested fields only."
PROMPT_FIELDS = {
    "taxonomy": "- Product category hierarchy (e.g., Furniture > Bedroom > Beds > Platform Beds)",
    "primary_color": "- Primary/dominant color",
    "secondary_color": "- Secondary/accent color",
    "primary_material": "- Primary material (what it's mostly made of)",
    "secondary_material": "- Secondary material",
    "style": "- Design style (modern, traditional, farmhouse, etc.)",
    "shape": "- Shape (rectangular, round, etc.)",
    "assembly": "- Assembly requirement (none, partial, full)",
}
TEXT_PROMPT = ("You are a product catalog specialist. Extract structured attributes from the following product "
               "listing. Return ONLY valid JSON.\n\n", "\n\nExtracted attributes (JSON):")
IMAGE_PROMPT = ("You are a product catalog specialist. You are given a product image and its text listing. Extract "
                "structured attributes by analyzing BOTH the image and the text. Return ONLY valid JSON.\n\n<image>\n",
                "\n\nExtracted attributes (JSON):")

# --- Fixed values: text corruption --------------------------------------------------------
STRIP_COLORS = ["red", "blue", "green", "yellow", "orange", "purple", "pink", "black", "white", "gray", "grey",
                "brown", "beige", "ivory", "cream", "navy", "teal", "turquoise", "gold", "silver", "bronze", "copper",
                "walnut", "espresso", "mahogany", "oak", "cherry", "maple", "tan", "charcoal", "coral", "burgundy",
                "maroon", "olive", "aqua", "emerald", "ruby", "sapphire", "amber", "caramel", "mocha", "slate",
                "pewter", "nickel", "chrome", "brushed", "matte", "glossy", "satin"]
STRIP_MATERIALS = ["wood", "wooden", "metal", "steel", "iron", "aluminum", "brass", "velvet", "leather", "fabric",
                   "cotton", "polyester", "linen", "silk", "microfiber", "suede", "vinyl", "acrylic", "glass",
                   "ceramic", "porcelain", "marble", "granite", "stone", "concrete", "bamboo", "rattan", "wicker",
                   "plastic", "resin", "foam", "plywood", "particleboard", "mdf", "hardwood", "softwood", "teak",
                   "pine", "birch", "ash", "rubber", "stainless", "wrought", "cast", "forged", "woven", "knitted",
                   "upholstered", "tufted", "nailhead", "bonded", "faux", "genuine", "solid", "manufactured",
                   "engineered", "reclaimed"]
STRIP_STYLES = ["modern", "contemporary", "traditional", "rustic", "industrial", "farmhouse", "coastal", "bohemian",
                "scandinavian", "mid-century", "minimalist", "vintage", "retro", "classic", "transitional", "glam",
                "artisan", "craftsman", "cottage", "french", "country", "shabby", "chic", "elegant", "luxurious",
                "ornate", "sleek"]
STRIP_ROOMS = ["bedroom", "living", "dining", "outdoor", "kitchen", "bathroom", "office", "patio", "nursery",
               "entryway", "hallway", "lounge"]
SWAP_COLORS = ["red", "blue", "green", "yellow", "black", "white", "gray", "brown", "beige", "navy", "teal", "orange",
               "purple", "pink"]
SWAP_MATERIALS = ["wood", "metal", "leather", "velvet", "fabric", "glass", "ceramic", "marble", "plastic", "cotton",
                  "polyester", "steel"]
SWAP_STYLES = ["modern", "traditional", "rustic", "industrial", "farmhouse", "coastal", "bohemian", "scandinavian",
               "minimalist", "vintage"]
MASK_COLORS = ["white", "ivory", "cream", "snow", "pearl", "alabaster", "eggshell", "black", "jet", "onyx", "ebony",
               "gray", "grey", "charcoal", "graphite", "pewter", "smoke", "heather", "brown", "chocolate", "espresso",
               "mocha", "cocoa", "coffee", "umber", "beige", "tan", "khaki", "sand", "taupe", "camel", "natural",
               "oatmeal", "wheat", "buff", "mushroom", "fawn", "parchment", "champagne", "bone", "ecru", "blue",
               "navy", "teal", "turquoise", "aqua", "cobalt", "sapphire", "indigo", "denim", "cerulean", "periwinkle",
               "cornflower", "green", "sage", "olive", "emerald", "mint", "lime", "seafoam", "jade", "moss", "fern",
               "pistachio", "red", "burgundy", "crimson", "maroon", "scarlet", "wine", "ruby", "brick", "cranberry",
               "garnet", "oxblood", "pink", "blush", "rose", "coral", "salmon", "fuchsia", "magenta", "mauve",
               "orange", "rust", "terracotta", "peach", "apricot", "tangerine", "amber", "copper", "cinnamon",
               "yellow", "gold", "mustard", "lemon", "honey", "golden", "sunflower", "purple", "lavender", "violet",
               "plum", "lilac", "eggplant", "amethyst", "orchid", "grape", "silver", "chrome", "platinum", "nickel",
               "brass", "bronze", "clear", "transparent", "multi", "multicolor", "multicolored", "rainbow"]
MASK_MATERIALS = ["wood", "wooden", "hardwood", "plywood", "mdf", "oak", "pine", "bamboo", "teak", "cedar", "birch",
                  "maple", "acacia", "rubberwood", "metal", "steel", "iron", "aluminum", "stainless", "chrome",
                  "zinc", "brass", "bronze", "wrought", "fabric", "polyester", "cotton", "linen", "microfiber",
                  "chenille", "tweed", "canvas", "satin", "silk", "velvet", "upholstered", "leather", "faux",
                  "bonded", "vegan", "plastic", "resin", "acrylic", "polycarbonate", "vinyl", "pvc", "marble",
                  "granite", "quartz", "stone", "concrete", "slate", "travertine", "limestone", "terrazzo", "ceramic",
                  "porcelain", "terracotta", "earthenware", "stoneware", "glass", "tempered", "frosted", "mirror",
                  "crystal", "wool", "jute", "sisal", "seagrass", "rattan", "wicker", "cane", "hemp", "foam",
                  "memory", "gel", "synthetic", "nylon", "olefin"]
MASK_SHAPES = ["rectangular", "rectangle", "square", "round", "circular", "circle", "oval", "oblong", "l-shaped",
               "l-shape", "u-shaped", "u-shape", "runner", "irregular", "hexagon", "hexagonal", "freeform"]
MASK_STYLES = ["modern", "contemporary", "traditional", "transitional", "rustic", "industrial", "coastal",
               "farmhouse", "mid-century", "bohemian", "boho", "glam", "scandinavian", "cottage", "tropical",
               "minimalist", "retro", "vintage", "classic", "eclectic"]
ASSEMBLY_PATTERNS = [
    r"(?:assembly|assemble)\s*(?:is\s+)?(?:required|needed|necessary)",
    r"(?:no|not?)\s*(?:assembly|assemble)\s*(?:required|needed)?",
    r"(?:fully|pre[\-\s]?)assembled",
    r"(?:partial|some)\s*assembly",
    r"(?:easy|simple|minimal)\s*assembly",
    r"(?:tools?\s*(?:included|required|needed))",
    r"assembly\s*(?:instructions?\s*)?included",
    r"arrives?\s*(?:fully\s*)?assembled",
    r"ready\s*to\s*(?:use|assemble)",
]
MATERIAL_PATTERNS = [
    r"(?:made|crafted|constructed|built)\s+(?:of|from|with)\s+(\w+(?:\s+\w+)?)",
    r"(?:solid|real|genuine|faux|bonded)\s+(?:wood|leather|marble|stone|metal)",
    r"(?:stainless\s+steel|wrought\s+iron|cast\s+iron|solid\s+wood)",
    r"(?:memory\s+foam|tempered\s+glass)",
]
TEXT_LEVELS = [("full", 0.15), ("partial", 0.15), ("name", 0.30), ("minimal", 0.20), ("empty", 0.20)]
MASK_RATES = [("color", 0.50), ("shape", 0.40), ("style", 0.20), ("material", 0.15)]
CORRUPTION_SHARES = [("vague", 0.50), ("adversarial", 0.30), ("original", 0.20)]

# --- Fixed values: image sourcing -----------------------------------------------------------
BLOCKED_DOMAINS = ["pinterest.com", "pinimg.com", "facebook.com", "fbcdn.net", "instagram.com", "tiktok.com",
                   "youtube.com", "ytimg.com", "aliexpress.com", "wish.com", "shutterstock.com", "gettyimages.com",
                   "istockphoto.com", "alamy.com", "depositphotos.com"]
GENERIC_WORDS = ["the", "and", "with", "for", "from", "inch", "wide", "tall", "deep", "set", "piece", "pack", "home",
                 "room", "living", "outdoor", "indoor", "new", "best", "top"]
LARGE_HINTS = ["1000", "1200", "1500", "2000", "large", "full"]
THUMB_HINTS = ["thumb", "50x50", "75x75", "100x", "icon", "tiny"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp"]
HERO_EXTENSIONS = ["jpg", "png", "webp"]
IMAGE_BYTES = (3_000, 15_000_000)
IMAGE_MAGIC = ["FFD8FF", "89504E470D0A1A0A", "52494646", "47494638"]  # JPEG, PNG, RIFF, GIF8
FAILED_STATUSES = ["no_results", "download_failed", "no_good_images"]
STOCK_ADJECTIVES = ["modern", "contemporary", "traditional", "farmhouse", "industrial", "rustic", "scandinavian",
                    "bohemian", "coastal", "mid-century", "velvet", "leather", "wood", "wooden", "metal", "glass",
                    "fabric", "upholstered", "tufted", "woven", "marble", "oak", "walnut", "white", "black", "gray",
                    "grey", "brown", "blue", "green", "red", "beige", "cream", "navy", "gold", "brass", "chrome",
                    "round", "square", "rectangular", "oval", "tall", "small", "large"]

# --- Fixed values: search ---------------------------------------------------------------------
RELEVANCE = {"Exact": 2, "Partial": 1, "Irrelevant": 0}
PAIR_SCORES = {"Exact": 1.0, "Partial": 0.5, "Irrelevant": 0.0}
COLOR_TERMS = ["red", "blue", "green", "yellow", "orange", "purple", "pink", "black", "white", "gray", "grey",
               "brown", "beige", "ivory", "cream", "navy", "teal", "turquoise", "gold", "silver", "bronze", "copper",
               "walnut", "espresso", "mahogany", "cherry", "oak", "tan", "charcoal"]
MATERIAL_TERMS = ["wood", "wooden", "metal", "steel", "iron", "velvet", "leather", "fabric", "cotton", "polyester",
                  "linen", "silk", "glass", "ceramic", "marble", "granite", "stone", "bamboo", "rattan", "wicker",
                  "plastic", "resin", "teak", "pine", "birch", "upholstered", "tufted"]
STYLE_TERMS = ["modern", "contemporary", "traditional", "rustic", "industrial", "farmhouse", "coastal", "bohemian",
               "scandinavian", "mid-century", "minimalist", "vintage", "retro", "classic", "transitional", "glam",
               "elegant", "sleek"]
TYPE_TERMS = ["sofa", "couch", "chair", "table", "desk", "bed", "dresser", "bookshelf", "bookcase", "cabinet",
              "nightstand", "bench", "ottoman", "stool", "rug", "lamp", "mirror", "shelf", "sectional", "loveseat",
              "recliner", "futon", "vanity", "wardrobe"]
QUERY_TERMS = {"color_family": COLOR_TERMS, "primary_material": MATERIAL_TERMS, "style": STYLE_TERMS,
               "product_type": TYPE_TERMS}
BOOST_WEIGHTS = {"color_family": 0.15, "primary_material": 0.10, "style": 0.10, "product_type": 0.15}

# --- Fixed values: evaluation, prices, model constants ---------------------------------------
EVAL_ATTRIBUTES = ["style", "primary_material", "color_family", "room_type", "product_type"]
F1_WEIGHTS = {"style": 1.5, "primary_material": 1.2, "color_family": 1.0, "room_type": 1.0, "product_type": 1.3}
SIMILAR_STYLES = [("contemporary", "modern"), ("traditional", "transitional"), ("farmhouse", "rustic"),
                  ("scandinavian", "minimalist"), ("industrial", "modern")]
COST_PER_1K = {"rule-based": 0.0, "bert": 0.02, "llava-base": 0.20, "llava": 0.20, "gpt4o": 10.00}
LATENCY_MS = {"rule-based": 2, "bert": 15, "llava-base": 380, "llava": 380, "gpt4o": 1200}
TOKEN_PRICES = {"gpt-4o": (0.005, 0.015), "gpt-4o-mini": (0.00015, 0.0006), "gpt-4-turbo": (0.01, 0.03)}
CATALOG_SIZE = 40_000_000

# --- Fixed values: routing ---------------------------------------------------------------------
UNKNOWN = "<UNK>"
TIER1, TIER2, MODALITY_CONFIDENT = 0.85, 0.70, 0.6
FALLBACK_CONFIDENCE, UNAVAILABLE_CONFIDENCE = 0.8, 0.5
KL_LIMIT, CONFIDENCE_LIMIT, MARGIN_LIMIT, ENTROPY_LIMIT = 2.0, 0.8, 0.1, 2.0
