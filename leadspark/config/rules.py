"""Rule values of cleaning, scoring and the cadence. Fixed values, stated as they are."""

BLOCKED_TERMS = [
    "bpo", "call center", "callcenter", "contact center", "outsourcing", "virtual assistant agency", "answering service",
    "va agency", "staffing agency", "recruiting agency", "recruitment agency", "marketing agency", "digital agency",
    "growth agency", "seo agency", "ads agency", "media buying", "lead generation agency", "smma", "social media agency",
    "web design agency", "branding agency", "business coach", "sales coach", "mindset coach", "online course", "masterclass",
    "ebook", "dropshipping course", "print on demand course", "affiliate marketing", "mlm", "network marketing", "crypto",
    "forex", "nft", "trading signals", "software company", "saas platform", "crm software", "app development",
    "franchise opportunity", "wholesale supplier", "b2b directory", "trade show", "expo",
]
FAN_PATTERNS = [r"\bfan (page|account)\b", r"\bnot affiliated\b", r"\bparody\b", r"\bbackup account\b", r"\bsecond account\b"]
RESELLER_PATTERNS = [
    r"\breseller\b", r"\bauthorized dealer\b", r"\bdistributor of\b", r"\bwe ship worldwide dm to order\b", r"\bdm to order\b",
    r"\breplica\b", r"\bdupe\b", r"\bpreorder only\b",
]
PERSONAL_THRESHOLD = 3
PERSONAL_BIO = [
    ("bio_personal_pronoun", 2, r"\b(i'm|im a|my name is|mom of|dad of|wife|husband|girlfriend|boyfriend)\b"),
    ("personal_role", 2, r"\b(content creator|influencer|blogger|model|photographer|artist|ugc creator|student|nurse|realtor)\b"),
]
BOUNDS = {"min_followers": 300, "max_followers": 250000, "max_ratio": 3.0, "min_posts": 6, "max_name": 120}
# The terms of each niche. Other niches come as a table (operators/niches.py).
NICHES = {
    "medspas": {
        "keywords": ["medspa", "med spa", "medical spa", "aesthetics", "botox", "filler", "injectables", "laser hair removal", "skin clinic", "iv therapy"],
        "negative": ["nail salon", "massage only", "tattoo removal franchise directory", "medspa marketing agency", "medspa consultant", "medspa software"],
    },
    "dental_clinics": {
        "keywords": ["dentist", "dental", "family dentistry", "cosmetic dentistry", "orthodontist", "invisalign", "implants", "pediatric dentist", "endodontist"],
        "negative": ["dental lab supplier", "dental marketing", "dental billing software", "dental school", "dental staffing agency"],
    },
    "pet_brands": {
        "keywords": ["pet", "dog", "cat", "pet accessories", "pet care", "dog harness", "pet supplements", "pet tech", "pet feeder", "litter box"],
        "negative": ["pet adoption shelter", "rescue nonprofit", "veterinary hospital group", "pet influencer", "dog account"],
    },
    "womens_bags": {
        "keywords": ["handbags", "purses", "tote", "crossbody", "leather bags", "women's accessories", "jewelry", "scarves", "clutch"],
        "negative": ["replica", "dupe", "reseller", "wholesale supplier directory", "thrift reseller"],
    },
    "home_robots": {
        "keywords": ["robot vacuum", "robot mower", "lawn robot", "pool robot", "window cleaning robot", "home robotics", "smart home robot", "autonomous yard"],
        "negative": ["robotics research lab", "industrial automation integrator", "robot toy", "university robotics club"],
    },
    "comfort_wear": {
        "keywords": ["loungewear", "comfort wear", "sleepwear", "pajamas", "cozy apparel", "athleisure", "basics apparel", "knitwear"],
        "negative": ["print on demand dropship course", "clothing wholesaler directory", "fashion blogger"],
    },
    "beauty_salons": {
        "keywords": ["hair salon", "beauty salon", "lash studio", "brow bar", "nail studio", "blowout bar", "hair extensions"],
        "negative": ["beauty school", "salon software", "beauty supply wholesaler"],
    },
    "fitness_accessories": {
        "keywords": ["gym accessories", "fitness equipment", "resistance bands", "lifting belts", "gym bag", "supplements", "recovery tools"],
        "negative": ["gym franchise", "personal trainer coaching program", "fitness influencer"],
    },
    "fashion_brands": {
        "keywords": ["fashion brand", "clothing brand", "streetwear", "womenswear", "menswear", "boutique"],
        "negative": ["fashion blogger", "styling course", "clothing wholesaler directory"],
    },
    "gym_wear": {
        "keywords": ["gym wear", "activewear", "workout clothes", "training apparel", "performance apparel", "leggings"],
        "negative": ["gym franchise", "fitness coaching program"],
    },
    "lingerie": {
        "keywords": ["lingerie", "intimates", "bras", "sleep and intimates", "shapewear"],
        "negative": ["adult content", "onlyfans", "modelling agency"],
    },
    "watches_eyewear": {
        "keywords": ["watch brand", "watches", "eyewear", "sunglasses", "optical frames", "blue light glasses"],
        "negative": ["watch reseller", "replica", "pawn shop", "optometrist practice"],
    },
    "car_accessories": {
        "keywords": ["car accessories", "auto accessories", "car detailing products", "floor mats", "car organizer", "dash cam", "car care"],
        "negative": ["car dealership", "auto repair shop", "car rental"],
    },
    "tech_products": {
        "keywords": ["consumer electronics", "smart home", "3d printer", "gadgets", "audio brand", "charging accessories", "hardware startup"],
        "negative": ["software agency", "IT services provider", "crypto", "app studio"],
    },
    "ecommerce_general": {
        "keywords": ["shop now", "online store", "dtc brand", "product brand", "free shipping", "new drop"],
        "negative": ["dropshipping course", "marketing agency", "print on demand tutorial", "affiliate marketer"],
    },
}
CAMPAIGN = {
    "states": ["CA", "TX"],
    "cities": ["los angeles", "san diego", "ft worth", "houston"],
    "exclude_cities": ["la jolla"],
}
WEIGHTS = {
    "location_fit": 14, "niche_fit": 15, "follower_fit": 12, "products_fit": 10, "business_quality": 12,
    "instagram_activity": 8, "website_quality": 5, "decision_maker": 8, "cx_need": 10, "outreach_potential": 6,
}
BANDS = [("HIGH_PRIORITY", 85), ("QUALIFIED", 70), ("REVIEW", 55), ("NOT_QUALIFIED", 0)]
PRIORITY = {"HIGH_PRIORITY": "high", "QUALIFIED": "medium", "REVIEW": "low", "NOT_QUALIFIED": "none"}
STOP_STATUSES = ["REPLIED", "INTERESTED", "NOT_INTERESTED", "NURTURE", "CLOSED", "OPTED_OUT"]
STOP_STAGES = ["REPLIED", "CONVERSATION", "INTERESTED", "NURTURE", "NOT_INTERESTED", "CLOSED"]
FOLLOWUP_KINDS = ["followup_1", "followup_2", "followup_3_final"]
DAY_OFFSETS = [2, 5, 9]
POSITIVE_REPLIES = ["interested", "curious", "positive", "wants_details", "pricing", "question"]

# Points of the signals for each service, and the limits of scores and offers.
SUPPORT_POINTS = {
    "Sells online": 30, "Sizeable product catalogue": 15, "Published returns or refunds policy": 12, "Multiple customer contact channels": 14,
    "Live chat already in place": 14, "Help centre or customer service page": 10, "Customer-facing hiring": 20, "Actively hiring": 6, "High public review volume": 10,
}
VOICE_POINTS = {
    "Appointment booking in use": 26, "Call-to-action asks customers to phone": 22, "Phone is a prominent contact channel": 20, "After-hours availability advertised": 14,
    "Appointment-led customer journey": 14, "Appointment-based business category": 8, "Phone-heavy business category": 8, "Phone number published": 6, "High public review volume": 10,
}
CAVEATS = ["Website could not be read", "No website on file"]
V1_BANDS = [("BEST", 80), ("GOOD", 65), ("REVIEW", 50), ("BAD", 0)]
NO_WEBSITE_CAP, UNREADABLE_SITE_CAP = 45, 55
MIN_FIT, BOTH_MIN, BOTH_MIN_SIGNALS = 45, 55, 2
