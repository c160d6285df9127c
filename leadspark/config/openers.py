"""What a first message may say: fixed values, in the order in which openers are tried.

An opener is tried for one signal and takes one fragment from its evidence ({x}): `quote` a quoted
piece of page copy, `booking` and `chat` the name of a product, `calls` and `products` a count of at
least `least`, `channels` the ways to get in touch, `none` nothing. Each list holds wordings of one
sentence; a number drawn from the company picks one.
"""

from __future__ import annotations

# Signals, wordings and phrases that decide the result.
VOICE, SUPPORT = "AI_VOICE", "CUSTOMER_SUPPORT"
OPENERS = [
    ("After-hours availability advertised", VOICE, "quote",
     ['Your site mentions "{x}".', 'Saw "{x}" on your site.', 'Your site says "{x}".'],
     ["What happens to the calls that land outside your normal hours.", "How is that covered when the front desk is closed.", "Where do the out-of-hours calls go."]),
    ("Call-to-action asks customers to phone", VOICE, "quote",
     ['"{x}" is the main prompt on your site.', 'Your site asks people to "{x}".', 'The site\'s main ask is "{x}".'],
     ["How are those calls answered at the moment.", "Who picks those up day to day.", "How is the phone covered through the day."]),
    ("Appointment booking in use", VOICE, "booking",
     ["You take bookings through {x}.", "Saw you're booking through {x}.", "{x} is handling your bookings.", "Your booking runs on {x}."],
     ["Do phone bookings go into {x} as well, or get typed in after.", "Does someone enter the phone bookings into {x} by hand.", "How do the calls end up in {x}.",
      "Do the bookings that come in by phone reach {x} the same way."]),
    ("Phone is a prominent contact channel", VOICE, "calls",
     ["Counted {x} click-to-call links on your site.", "Your site has {x} tap-to-call links on it.", "There are {x} tap-to-call links across your site.",
      "{x} places on your site put the phone number in front of people."],
     ["How are the calls handled right now.", "Who is answering those during treatments.", "Who is on the phone while the room is busy.", "How is that handled at the moment."]),
    ("Appointment-led customer journey", VOICE, "quote",
     ['Your site leads with "{x}".', '"{x}" is the first thing your site asks for.', '"{x}" is what your site points people at.'],
     ["Do most of those come in by phone or through the website.", "How do most of those bookings actually arrive.", "Is it mostly phone or mostly online."]),
    ("Live chat already in place", SUPPORT, "chat",
     ["You've got {x} chat running on the site.", "Saw {x} chat live on your site.", "{x} chat is live on your site."],
     ["What hours is it actually staffed.", "Who is covering it outside office hours.", "What hours does someone sit behind it."]),
    ("Multiple customer contact channels", SUPPORT, "channels",
     ["Your site lists {x} as ways to get in touch.", "You're reachable on {x}.", "Your contact page offers {x}."],
     ["Is that all landing with one person.", "Who covers all of those day to day.", "Does all of that land in one place."]),
    ("Customer-facing hiring", SUPPORT, "quote",
     ['Your careers page mentions "{x}".', 'Saw "{x}" on your careers page.'],
     ["Is that for extra coverage or for extra volume.", "What is driving that hire."]),
    ("Sells online", SUPPORT, "none",
     ["You sell online as well as in the clinic.", "You've got an online store alongside the clinic."],
     ["Who handles the order and delivery questions.", "Where do the order questions land."]),
    ("Published returns or refunds policy", SUPPORT, "none",
     ["Your site publishes a returns policy.", "Saw you have a returns and refunds page."],
     ["Who works through those requests.", "Where do those requests go."]),
    ("Help centre or customer service page", SUPPORT, "none",
     ["Your site has a proper customer service section.", "You publish a help section on the site."],
     ["How much still comes in as a DM or an email anyway.", "Does that cut the direct questions down much."]),
    ("Sizeable product catalogue", SUPPORT, "products",
     ["Counted {x} products and collections on your site.", "Your site lists {x} products."],
     ["Who fields the questions about those.", "Where do the product questions land."]),
]
CAPABILITIES = {
    VOICE: [
        "we put an AI receptionist on inbound calls - it answers, handles the routine questions and books appointments",
        "we run AI receptionists that answer the phone, deal with the usual questions and take bookings",
        "we set up an AI receptionist to answer calls, handle common questions and book people in",
    ],
    SUPPORT: [
        "we provide outsourced support staff to add email, chat and phone cover",
        "we run outsourced support teams that take email, chat and phone load off the in-house team",
        "we staff outsourced customer support - email, chat and phone - alongside an in-house team",
    ],
}
MENTIONED = {VOICE: "AI voice receptionist", SUPPORT: "Customer support outsourcing"}
NAMED = {VOICE: "AI receptionist", SUPPORT: "outsourced support"}
INTRODUCTIONS = ["I'm {name} at {company} -", "{name} here, {company} -", "I'm {name}, {company} -"]
GENERAL = ["Most {x}s I speak to still take bookings and questions over the phone.", "Nearly every {x} I talk to runs booking enquiries through the phone."]
GENERAL_QUESTION = "How does that work at your end"
NO_MESSAGE = "No message composed: the evidence does not support an approach."
NO_SIGNAL = "No medium or high confidence signal was available, so this stays general and asks an open question rather than claiming anything about this business."
BANNED = [
    "hope this message finds you well", "i wanted to reach out", "quick question", "i came across your profile", "love your feed", "love your page", "your team is overwhelmed",
    "you must be missing", "you're losing", "you are losing", "response times must", "solutions provider", "leverage", "streamline", "synergy", "scale your operations",
    "drive efficiencies", "are you free this week", "book a call", "calendar link", "game changer", "circle back", "touch base", "reach out to discuss",
]
GENDERED = r"\b(he|him|his|she|her|hers)\b"
SITE_CHROME = (
    r"\b(facebook-f|facebook|instagram|twitter|tiktok|youtube|linkedin|pinterest|yelp|skip to content|menu|navigation|toggle|cookie|privacy policy|terms of service|all rights reserved|copyright)\b"
)
NOT_COPY = r"[@|·•>]|https?:|www\."
PHONE_NUMBER = r"\d{3}[.\s-]\d{3}[.\s-]\d{4}"
CONTACT = r"^(email|phone|live chat|chat|contact form|whatsapp|sms|text)$"
FIRST_NAME = r"^[A-Za-z][A-Za-z'’-]{1,20}$"
LONGEST_QUOTE, MOST_CHARACTERS = 64, 500
