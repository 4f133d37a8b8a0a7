"""Label words of receipts.  Fixed values, in order of precedence."""

TOTAL = ("total", "grand total", "amount due", "balance due", "المجموع", "الإجمالي")
SUBTOTAL = ("subtotal", "sub-total", "sub total", "net amount")
TAX = ("tax", "vat", "gst", "hst", "sales tax", "الضريبة")
DISCOUNT = ("discount", "coupon", "promo", "less", "savings", "خصم")
RECEIPT_NUMBER = ("receipt #", "receipt no", "receipt number", "invoice #", "invoice no", "invoice number", "order #", "order no", "transaction id", "trans id", "ref no", "reference no")
PAYMENT = (
    ("visa", ("visa",)),
    ("mastercard", ("mastercard", "master card")),
    ("amex", ("amex", "american express")),
    ("upi", ("upi",)),
    ("cheque", ("cheque", "check")),
    ("cash", ("cash",)),
    ("credit_card", ("credit card", "credit")),
    ("debit_card", ("debit card", "debit")),
    ("card", ("card",)),
)
SUMMARY = TOTAL + SUBTOTAL + TAX + DISCOUNT
NOISE = r"(?iU)^(receipt|invoice|order|thank you|welcome|tel|phone|www\.|http)"

#: Currency signs with one meaning, signs with several, and dollar prefixes.
SIGNS = (("$", "USD"), ("€", "EUR"), ("₹", "INR"), ("₨", "INR"), ("₦", "NGN"), ("£", "GBP"), ("₩", "KRW"), ("₱", "PHP"), ("₺", "TRY"), ("ر.س", "SAR"))
SHARED_SIGNS = (("¥", ("JPY", "CNY")), ("Rs", ("PKR", "INR", "LKR", "NPR")), ("₨", ("INR", "PKR")))
DOLLARS = (("AU$", "AUD"), ("A$", "AUD"), ("CA$", "CAD"), ("C$", "CAD"), ("NZ$", "NZD"), ("HK$", "HKD"), ("S$", "SGD"))
CURRENCY_CODES = ("USD", "EUR", "GBP", "INR", "PKR", "NGN", "JPY", "CNY", "KRW", "PHP", "TRY", "SAR", "AED", "AUD", "CAD", "NZD", "HKD", "SGD", "LKR", "NPR", "BDT", "ZAR", "BRL", "MXN", "IDR", "THB", "VND", "MYR", "EGP", "KES")
