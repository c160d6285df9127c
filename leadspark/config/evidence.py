"""Fixed values of website research and signals: patterns decide results, so they are stated as they are."""

#: name, kind, pattern (any case)
TECHNOLOGIES = [
    ("Shopify", "ecommerce", r"cdn\.shopify\.com|shopify\.com/s/files|Shopify\.theme|myshopify\.com"),
    ("WooCommerce", "ecommerce", r"woocommerce|wc-ajax|wp-content/plugins/woocommerce"),
    ("BigCommerce", "ecommerce", r"bigcommerce\.com|cdn\d*\.bigcommerce"),
    ("Magento", "ecommerce", r"/static/version\d+/frontend|Magento_"),
    ("Squarespace Commerce", "ecommerce", r"squarespace.*commerce|sqs-add-to-cart"),
    ("WordPress", "cms", r"wp-content|wp-includes|wp-json"),
    ("Squarespace", "cms", r"squarespace\.com|static1\.squarespace"),
    ("Wix", "cms", r"wix\.com|wixstatic\.com|_wixCssStates"),
    ("Webflow", "cms", r"webflow\.com|webflow\.js"),
    ("GoDaddy Website Builder", "cms", r"godaddysites\.com|img1\.wsimg\.com"),
    ("Intercom", "support", r"intercom\.io|intercomcdn"),
    ("Zendesk", "support", r"zendesk\.com|zdassets\.com"),
    ("Gorgias", "support", r"gorgias\.(com|chat)"),
    ("Tidio", "support", r"tidio\.co|tidiochat"),
    ("Drift", "support", r"drift\.com|driftt\.com"),
    ("LiveChat", "support", r"livechatinc\.com|livechat\.com"),
    ("Crisp", "support", r"crisp\.chat"),
    ("HubSpot", "support", r"hs-scripts\.com|hubspot\.com"),
    ("Podium", "support", r"podium\.com"),
    ("Birdeye", "support", r"birdeye\.com"),
    ("Calendly", "booking", r"calendly\.com"),
    ("Acuity Scheduling", "booking", r"acuityscheduling\.com|squarespacescheduling\.com"),
    ("Vagaro", "booking", r"vagaro\.com"),
    ("Booksy", "booking", r"booksy\.com"),
    ("Mindbody", "booking", r"mindbodyonline\.com|mindbody\.io"),
    ("Square Appointments", "booking", r"squareup\.com/appointments|square\.site"),
    ("Aesthetic Record", "booking", r"aestheticrecord\.com"),
    ("Boulevard", "booking", r"joinboulevard\.com"),
    ("Zocdoc", "booking", r"zocdoc\.com"),
    ("SimplePractice", "booking", r"simplepractice\.com"),
    ("Jane", "booking", r"janeapp\.com"),
]
SOCIALS = {
    "instagram": r"(?:https?://)?(?:www\.)?instagram\.com/([A-Za-z0-9._]{1,30})",
    "facebook": r"(?:https?://)?(?:www\.)?facebook\.com/([A-Za-z0-9._\-/]{2,60})",
    "linkedin": r"(?:https?://)?(?:www\.)?linkedin\.com/(company/[A-Za-z0-9._\-]{2,60}|in/[A-Za-z0-9._\-]{2,60})",
    "twitter": r"(?:https?://)?(?:www\.)?(?:twitter|x)\.com/([A-Za-z0-9_]{1,15})",
    "tiktok": r"(?:https?://)?(?:www\.)?tiktok\.com/@([A-Za-z0-9._]{1,30})",
    "youtube": r"(?:https?://)?(?:www\.)?youtube\.com/(channel/[\w-]+|@[\w.-]+|c/[\w-]+)",
}
SUPPORT_ROLES = (
    r"(customer (support|service|experience|care)|support (rep|representative|agent|specialist|advisor)|client services|patient coordinator"
    r"|front desk|receptionist|call cent(er|re)|dispatcher|help desk|service advisor)"
)
HIRING = r"(we'?re hiring|now hiring|join our team|careers?|open positions?|job openings?|apply now|employment opportunities)"
BOOKING = (
    r"(book (now|online|an? appointment|a consultation)|schedule (now|online|an? appointment|a consultation)|request an? appointment"
    r"|make an appointment|reserve your spot|book your)"
)
CALL = r"(call (us|now|today|to book|for)|give us a call|speak (to|with) (us|our team)|phone us|call our|tap to call)"
_COVERAGE = r"\b(answers?|answering|calls?|phones?|reach|staff(ed)?|teams?|support|service|open|available|assist|help)\b"
AFTER_HOURS = (
    rf"((24/7|24 hours|around the clock|available anytime|nights and weekends)[^.!?]{{0,60}}{_COVERAGE}"
    rf"|{_COVERAGE}[^.!?]{{0,60}}(24/7|24 hours|around the clock|after hours|nights and weekends)"
    r"|after[- ]hours \b(answer\w*|call\w*|phone|service|line|support|coverage)\b|emergency \b(service|line|call|number)\b)"
)
NOT_AFTER_HOURS = (
    r"(portal|app|online (access|account|ordering|booking|store)|self[- ]serve|website|dashboard|financing|loan|payment plan|chatbot|aftercare|downtime"
    r"|recovery|swelling|bruising|numbing|avoid |refrain|strenuous|sauna|steam room|for at least|within \d+ hours?|in only \d+ hours?"
    r"|results? (can|may|will|take)|post[- ](treatment|procedure|op)|return to (your|their) (normal|everyday|regular|routine|daily)|notice|cancel|resched"
    r"|within the next|we('ll| will) (call|contact|respond|get back)|respon(d|se) (within|time)|access available|book online 24)"
)
RETURNS = r"(returns?|refunds?|exchange)"
HELP = r"(help cent(er|re)|knowledge base|support cent(er|re)|customer service)"
PRODUCT_LINK = r'href="[^"]*/(product|products|shop|store|collections|item)/'
CART = r"add to cart|add-to-cart|addtocart|/cart|checkout"
RETURNS_LINK = r'href="[^"]*(return|refund|exchange)'
FORM = r"<form[\s\S]{0,600}(email|message|enquiry|inquiry|contact)"
CAREERS_LINK = r'href="[^"]*(careers?|jobs|employment|work-with-us)'
MAILTO = r"mailto:([^\"'?\s>]+)"
TEL = r'href="tel:([^"]+)"'
TITLE = r"<title[^>]*>([\s\S]*?)</title>"
DESCRIPTION = r"<meta[^>]+name=[\"']description[\"'][^>]+content=[\"']([^\"']+)[\"']"
#: Entities written out; amp comes last, so that nothing is decoded twice.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "reg": "(R)", "trade": "(TM)", "copy": "(C)", "rsquo": "'", "lsquo": "'",
    "rdquo": '"', "ldquo": '"', "mdash": "-", "ndash": "-", "hellip": "...", "deg": " degrees", "eacute": "e", "bull": "-", "amp": "&",
}
#: Kinds of listed values, and how many of each a lead keeps, in page order.
KEPT = {
    "technology": len(TECHNOLOGIES), "channel": 6, "shop": 2, "email": 5, "number": 5, "call": 3, "book": 3, "hiring": 3, "hours": 3,
    "chat": 1, "booking": 1, **dict.fromkeys(SOCIALS, 5),
}

# Categories of businesses with phone-shaped and appointment-shaped customers.
PHONE_HEAVY = (
    r"(spa|medical spa|aesthet|dental|dentist|orthodont|clinic|physician|doctor|chiropract|veterinar|salon|funeral|cremat|mortuar|cemeter|real estate|realtor"
    r"|insurance|law|attorney|plumb|hvac|electric|roofing|contractor|landscap|pest|locksmith|garage|auto repair|towing|dealership|moving|storage|logistics"
    r"|trucking|courier|freight|dispatch|hotel|resort|restaurant|catering)"
)
APPOINTMENT_LED = (
    r"(spa|aesthet|dental|dentist|orthodont|clinic|salon|barber|tattoo|physician|doctor|therap|chiropract|veterinar|consultan|studio|fitness|gym|yoga)"
)
