"""Category taxonomy and other fixed reference values.

Everything in the block below is a FIXED VALUE that must equal the behaviour
being reproduced (keyword lists and their order decide labels, the category
lists decide needs/wants, the tips and month names appear in outputs). They
are kept as plain text, in their natural order, in one place.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (do not reorder: first keyword hit in this order wins)
# ---------------------------------------------------------------------------

INCOME_KEYWORDS: dict[str, list[str]] = {
    "Salary": ["SALARY", "CONSULTANCY CHARGES", "A2AINT01", "PAYROLL", "HR DEPT", "WAGE"],
    "Refund": ["REV-UPI", "REFUND", "REVERSAL"],
    "Interest": ["INTEREST", "DIVIDEND", "INT PAID"],
    "Transfer In": ["NEFT", "IMPS", "UPI CREDIT", "CASHBACK", "REWARD", "RTGS"],
    "Freelance": ["FREELANCE", "CONSULTING", "CONTRACT"],
    "Rental Income": ["RENT RECEIVED", "TENANT", "LEASE"],
}

EXPENSE_KEYWORDS: dict[str, list[str]] = {
    "Food & Dining": [
        "ZOMATO", "SWIGGY", "STARBUCKS", "HAVE A BREAK", "CAFE", "RESTAURANT",
        "DOMINOS", "PIZZA", "MCDONALD", "KFC", "DUNKIN", "BURGER",
    ],
    "Groceries": [
        "BLINKIT", "GROFERS", "SUPERMARKET", "BIGBASKET", "JIOMART",
        "DMART", "RELIANCE FRESH", "SPENCER", "MORE RETAIL",
    ],
    "Transportation": [
        "UBER", "OLA", "UBERRIDE", "TAXI", "METRO", "RAPIDO",
        "IRCTC", "RAILWAY", "REDBUS", "BUS TICKET",
    ],
    "Shopping": [
        "TANISHQ", "FASHNEAR", "MEESHO", "AMAZON", "PAYTM MALL",
        "FLIPKART", "MYNTRA", "AJIO", "NYKAA", "TATA CLIQ",
    ],
    "Subscriptions": [
        "APPLE SERVICES", "APPLE MEDIA SERVICES", "NETFLIX", "SPOTIFY", "PRIME",
        "HOTSTAR", "YOUTUBE PREMIUM", "JIOCINEMA", "DISNEY",
    ],
    "Utilities": [
        "CESC LIMITED", "ELECTRIC", "WATER", "UTILITY", "BILL",
        "BROADBAND", "WIFI", "INTERNET", "GAS BILL", "PHONE BILL",
    ],
    "Fuel": ["FUEL ST", "PETROL", "GAS STATION", "DIESEL", "IOCL", "BPCL", "HPCL"],
    "Healthcare": [
        "HOSPITAL", "PHARMACY", "MEDICAL", "DOCTOR", "CLINIC",
        "APOLLO", "MEDPLUS", "1MG", "PHARMEASY", "NETMEDS",
    ],
    "Education": [
        "SCHOOL", "COLLEGE", "TUITION", "COURSE", "UDEMY",
        "COURSERA", "UNACADEMY", "BYJU",
    ],
    "Rent": ["RENT", "HOUSING", "PG CHARGES", "HOSTEL"],
    "Entertainment": [
        "MOVIE", "BOOKMYSHOW", "PVR", "INOX", "GAMING",
        "STEAM", "PLAYSTATION",
    ],
    "Travel": [
        "MAKEMYTRIP", "GOIBIBO", "CLEARTRIP", "HOTEL", "AIRBNB",
        "OYO", "AIRLINE", "FLIGHT", "INDIGO", "AIRINDIA",
    ],
    "Personal Care": ["SALON", "SPA", "PARLOUR", "GROOMING", "URBANCLAP"],
}

SAVINGS_KEYWORDS: dict[str, list[str]] = {
    "Mutual Fund SIP": ["INVESTNOWIP", "SIP", "MUTUAL FUND", "MF PURCHASE"],
    "Insurance": ["BAJAJ ALLIANZ LIFE", "LIC", "INSURANCE", "HDFC LIFE", "ICICI PRUDENTIAL"],
    "Fixed Deposit": ["FD", "FIXED DEPOSIT", "RD", "RECURRING DEPOSIT"],
    "Retirement": ["EPF", "PPF", "NPS", "RETIREMENT", "PENSION"],
    "Stocks": ["ZERODHA", "GROWW", "UPSTOX", "SHARE PURCHASE", "EQUITY"],
    "Gold": ["GOLD", "SOVEREIGN GOLD BOND", "SGB", "DIGITAL GOLD"],
}

DISCRETIONARY_CATEGORIES = [
    "Food & Dining", "Shopping", "Subscriptions", "Entertainment",
    "Personal Care", "Travel",
]

NEEDS_CATEGORIES = [
    "Rent", "Groceries", "Utilities", "Transportation", "Healthcare",
    "Education", "Fuel",
]

# First tip of each category (the only one ever shown) and the default text.
CATEGORY_TIPS = {
    "Food & Dining": "Consider meal prepping on weekends to reduce takeout spending.",
    "Shopping": "Use a 48-hour rule: wait before making non-essential purchases.",
    "Subscriptions": "Audit all active subscriptions — cancel unused ones.",
    "Transportation": "Consider carpooling or public transport for regular commutes.",
    "Groceries": "Plan weekly meals and make a shopping list before buying.",
    "Fuel": "Maintain proper tire pressure to improve fuel efficiency.",
    "Entertainment": "Look for free events and activities in your city.",
    "Utilities": "Switch to LED lighting to reduce electricity bills.",
}
DEFAULT_TIP = "Review this spending category for savings opportunities."

MONTH_NAMES = [
    "", "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

# (name, month, day, duration_days)
DEFAULT_FESTIVALS = [
    ("Diwali", 10, 20, 5),
    ("Christmas", 12, 25, 3),
    ("Holi", 3, 14, 2),
    ("Eid", 3, 30, 3),
    ("Durga Puja", 10, 10, 5),
    ("New Year", 12, 31, 2),
    ("Raksha Bandhan", 8, 19, 1),
    ("Ganesh Chaturthi", 9, 7, 3),
]

CONFIDENCE_THRESHOLD = 0.7
FESTIVAL_ALERT_DAYS = 21
CURRENCY_SYMBOL = "₹"

# Date formats tried in order (Spark datetime patterns).
DATE_FORMATS = ["yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-MMM-yyyy"]

REQUIRED_CSV_COLUMNS = ["Date", "Narration", "Debit Amount", "Credit Amount"]

# Texts shown to the user.
SUGGESTION_MESSAGES = {
    "budget_overrun": "You've exceeded your {category} budget by {excess} ({used}% used). Consider reducing spending here.",
    "budget_warning": "{category} spending is at {used}% of budget. Only {remaining} remaining.",
    "discretionary_spending": "{category} is one of your top discretionary expenses (total: {total}). {tip}",
    "subscription_audit": "You have {count} recurring subscriptions costing ~{annual}/year. Review and cancel unused ones.",
    "spending_ratio": "Your discretionary spending ({wants}%) exceeds the recommended 30%. Try to redirect some towards savings.",
    "savings_low": "Your savings rate ({savings}%) is below the recommended 20%. Consider automating savings via SIPs or RDs.",
}
FESTIVAL_MESSAGES = {
    "today": "{name} is today!",
    "tomorrow": "{name} is tomorrow!",
    "later": "{name} is in {days} days!",
    "history": " Based on your history, you typically spend around {symbol}{average} during this period",
    "extra": " ({symbol}{extra} more than normal months). Consider saving {symbol}{suggested} extra.",
    "no_history": " Plan ahead and set aside some extra savings for festive expenses.",
}
ALLOCATION_DESCRIPTIONS = {
    "needs": "Essentials: Rent, Groceries, Utilities, Transportation, Healthcare",
    "wants": "Discretionary: Dining, Shopping, Entertainment, Subscriptions",
    "savings": "Savings & Investments: SIP, FD, Insurance, Emergency Fund",
}

# ---------------------------------------------------------------------------
# End of fixed values
# ---------------------------------------------------------------------------

EXPENSE = "Expense"
SAVINGS = "Savings/Investment"
INCOME = "Income"

# Label groups in match priority order.
KEYWORD_GROUPS: list[tuple[str, dict[str, list[str]]]] = [
    (EXPENSE, EXPENSE_KEYWORDS),
    (SAVINGS, SAVINGS_KEYWORDS),
    (INCOME, INCOME_KEYWORDS),
]

ALL_EXPENSE_CATEGORIES = list(EXPENSE_KEYWORDS)
ALL_SAVINGS_CATEGORIES = list(SAVINGS_KEYWORDS)
ALL_INCOME_CATEGORIES = list(INCOME_KEYWORDS)


def ordered_categories() -> list[tuple[int, str, str, list[str]]]:
    """(priority, label_group, category, keywords) in match order."""
    out = []
    for group, table in KEYWORD_GROUPS:
        for cat, kws in table.items():
            out.append((len(out), group, cat, kws))
    return out
