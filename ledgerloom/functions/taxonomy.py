"""Fixed values of the domain: labels with exemplars, known entities, bank profiles, layouts, metadata patterns.

Results depend on these strings and on their order, so they are stated as they are.
"""

# Domain, label, exemplars, in the order that decides ties.
TAXONOMY: dict[str, dict[str, list[str]]] = {'Transaction Mode': {'UPI': ['UPI payment Unified Payments Interface instant mobile remittance',
                              'UPI CR UPI DR UPI-TRANSFER mobile barcode payment'],
                      'NEFT': ['NEFT National Electronic Funds Transfer interbank payment electronic settlement',
                               'NEFT Dr NEFT Cr interbank remittance'],
                      'RTGS': ['RTGS Real Time Gross Settlement fund transfer high value payment', 'RTGS Dr RTGS Cr high value settlement'],
                      'IMPS': ['IMPS Immediate Payment Service 24x7 instant remittance branch transfer', 'IMPS Dr IMPS Cr IMPS BRN instant transfer'],
                      'ATM': ['ATM WDL ATM Cash automated teller machine cash withdrawal', 'ATM Cash Withdrawal self cash payout ATM'],
                      'Cash / BNA': ['CASH BNA Branch Cash Deposit Automated Machine transaction',
                                     'Cash Deposit BNA Deposit cash counter branch teller'],
                      'Cheque / Clearing': ['Chq Paid Cheque clearing MICR Inward Clearing cheque settlement',
                                            'By Clg Clearing Cheque clearing house outward clearing'],
                      'NetBanking': ['Online Banking NetBanking digital internet transaction fee charges',
                                     'NetBanking portal web transaction fund transfer'],
                      'Bank Charges': ['Service Charges statement charges cheque book charges fee',
                                       'Maintenance charges annual fee SMS charges markup fee']},
 'Transaction Direction': {'Debit': ['Dr Debit outgoing payment money debited debit transfer',
                                     'UPI DR NEFT Dr RTGS Dr IMPS Dr Debit payment transfer out',
                                     'Cash Withdrawal ATM WDL funds withdrawn debit outflow payout',
                                     'Chq Paid Cheque Paid amount debited outward clearing'],
                           'Credit': ['Cr Credit incoming payment money credited credit received',
                                      'UPI CR NEFT Cr RTGS Cr IMPS Cr Credit received transfer in',
                                      'Cash Deposit BNA Deposit funds deposited credit inflow deposit',
                                      'MICR Inward Clearing By Clg credit incoming cheque clearing']},
 'Transaction Purpose': {'Personal / P2P Transfer': ['UPI transfer to individual person friend family relative personal send money peer to peer',
                                                     'Personal payment to individual private transfer friend colleague known person',
                                                     'Money sent to person private individual self transfer family member'],
                         'Salary / Payroll': ['SALARY TRF Salary transfer monthly employee payroll remuneration staff pay wages bonus',
                                              'Company salary disbursement monthly remuneration IMPS BRN SALARY',
                                              'Employee salary credit payroll disbursement wages monthly salary'],
                         'Rent / Lease': ['RENT PAYMENT MONTHLY RENT house office rent lease payment commercial rent',
                                          'Property rental accommodation lease payment landlord house rent'],
                         'Software / SaaS': ['SOFTWARE SUBSCRIPTION tech cloud software license SaaS billing IT tools web services',
                                             'Cloud hosting subscription digital license Google Apple Microsoft Adobe fee'],
                         'Utility / Bills': ['UTILITY PAYMENT electricity water gas internet broadband telephone bill mobile recharge power',
                                             'Electricity board MSEB BESCOM TNEB TORRENT TPDDL power bill payment BSNL Jio Airtel recharge'],
                         'Bank Charges': ['Service Charges Online Banking Charges internet fee maintenance fee annual charges SMS',
                                          'Service Charges Cheque Book Statement Charges Foreign Currency Markup fee penalty'],
                         'Investment / Wealth': ['INVESTMENT SERVICES mutual funds securities wealth management trading stocks shares SIP Zerodha '
                                                 'Groww',
                                                 'Portfolio investment capital market securities dividend equity demat brokerage'],
                         'Healthcare / Medical': ['HEALTHCARE Medical pharma wellness medicines clinic doctor hospital Apollo MedPlus pharmacy',
                                                  'Pharmacy diagnostic lab health centre remedies medical bill doctor consultation'],
                         'Food & Dining': ['Zomato Swiggy food delivery restaurant dining cafe coffee bakery canteen mess snacks fast food',
                                           'Restaurant hotel food beverage juice centre Amul parlour tea stall eatery meal takeaway'],
                         'Daily Needs / Retail': ['DAILY NEEDS groceries supermarket consumer essentials Blinkit Zepto Dunzo BigBasket DMart',
                                                  'Retail shopping clothing product purchase department store mall consumer goods household'],
                         'ATM Withdrawal': ['ATM cash withdrawal automated teller machine self cash payout ATM WDL',
                                            'ATM withdrawal cash self branch ATM machine money withdrawn'],
                         'Travel & Transport': ['Uber Ola cab taxi auto IRCTC railway flight airline hotel MakeMyTrip petrol fuel booking',
                                                'Travel transport logistics cab ride airline ticket hotel stay bus KSRTC GSRTC']},
 'Bank / Institution': {'HDFC Bank': ['HDFC BANK LTD commercial banking institution financial corporation'],
                        'Citi Bank': ['CITI BANK N.A. CIT foreign bank financial institution'],
                        'ICICI Bank': ['ICICI Bank Ltd commercial banking corporation'],
                        'State Bank of India (SBI)': ['State Bank of India SBI nationalized bank public sector'],
                        'Axis Bank': ['Axis Bank commercial banking corporation'],
                        'Kotak Mahindra Bank': ['Kotak Mahindra Bank commercial banking private bank'],
                        'Bank of Baroda': ['Bank of Baroda commercial banking public sector'],
                        'Clearing House (MICR)': ['DEL ACCTS Clearing House MICR banking system institution inward outward clearing'],
                        'Branch BNA': ['BNA Branch Network Automated Cash Machine bank branch teller']}}

# Entities, in the order in which they are looked for.
ENTITIES = ['CONSUMER PRODUCTS INDIA',
 'DAILY NEEDS LIMITED',
 'WEBSTREAM LIMITED',
 'RETAIL BRANDS CORP',
 'COURIER NETWORKS INDIA',
 'COMMERCIAL PROPERTIES INDIA',
 'CONSUMER ESSENTIALS INDIA',
 'PROPERTY DEVELOPERS CORP',
 'FINANCIAL PRODUCTS LTD',
 'MEDICAL SOLUTIONS INDIA',
 'TRADING HOUSE LTD',
 'URBAN CONSTRUCTIONS',
 'NETFORGE TECHNOLOGIES',
 'PREMIUM PROPERTIES LTD',
 'FOUNDATION PROJECTS LTD',
 'DATABRIDGE INFOTECH',
 'FASHION TEXTILES LTD',
 'REMEDIES HEALTHCARE',
 'WELLNESS BRANDS INDIA',
 'HEALTHCARE PRODUCTS LTD',
 'CYBERCRAFT SYSTEMS',
 'ESTATE BUILDERS INDIA',
 'HEALTHPLUS PHARMA LTD',
 'GATEWAY PROJECTS LTD',
 'URBAN ESTATES INDIA',
 'MOTOR INDUSTRIES LTD',
 'SKYLINE BUILDERS',
 'MINDWAVE CONSULTING',
 'THERMAL SYSTEMS LTD',
 'MEDCARE LABORATORIES',
 'CLOUDTECH SERVICES',
 'VITALITY MEDICINES LTD',
 'CARGO SOLUTIONS LTD',
 'CLOTHING INDUSTRIES LTD',
 'CITYSCAPE DEVELOPERS',
 'MECHANICAL SOLUTIONS LTD',
 'MARKET DISTRIBUTORS CORP',
 'RESIDENTIAL PROJECTS LTD',
 'POWER SYSTEMS CORP',
 'LOAN FINANCE CORP',
 'COMMERCE SOLUTIONS LTD',
 'BUILDING SOLUTIONS LTD',
 'WELLNESS LABS INDIA',
 'RAMESH VORA',
 'NISHA JHAVERI',
 'KETAN MODI',
 'KAVITA AMIN',
 'SEJAL DAVE',
 'NILESH DOSHI',
 'NEHA PAREKH',
 'DHARA KOTHARI',
 'BHAVESH MODI',
 'RITU MEHTA',
 'RIDDHI BHATT',
 'ANJALI SHUKLA',
 'POOJA BHATT',
 'RAKESH VORA',
 'PRIYA VORA',
 'DINESH PAREKH',
 'KINJAL AMIN',
 'FORAM VYAS',
 'MANISH VYAS',
 'HIRAL PAREKH',
 'MANISH TRIVEDI',
 'SHRUTI MODI',
 'ASHISH THAKKAR',
 'MEHUL DAVE',
 'SURESH PAREKH',
 'SURESH DESAI',
 'MEHUL PATEL',
 'FORAM AMIN',
 'ANJALI DAVE',
 'RITU PATEL',
 'HITESH KOTHARI',
 'RAJESH VORA',
 'KAVITA GANDHI',
 'PRIYA MODI',
 'KAVITA DESAI',
 'ASHISH KOTHARI',
 'PRIYA MEHTA',
 'HIRAL JOSHI',
 'MEHUL PANDYA',
 'JAYESH VORA',
 'BHAVESH THAKKAR',
 'SEJAL PATEL',
 'KAVITA KOTHARI',
 'SHRUTI MEHTA',
 'ASHISH AMIN',
 'NISHA MEHTA',
 'PARESH PARIKH',
 'ANJALI PATEL',
 'FORAM JOSHI',
 'DHARA THAKKAR',
 'JAYESH MODI',
 'NEHA DESAI',
 'ASHISH DAVE',
 'NILESH PARIKH']

# Bank name and the lower-case strings that give it away, in order.
BANKS = [('Velocity Banking Corporation', ['velocity banking', 'velo0']),
 ('Prosperity Bank Limited', ['prosperity bank', 'pros0']),
 ('Metropolitan Bank', ['metropolitan bank', 'metr0']),
 ('INDUSBANK LIMITED', ['indusbank', 'indu0']),
 ('UNITY NATIONAL BANK', ['unity national bank', 'unit0']),
 ('HDFC Bank Limited', ['hdfc bank', 'hdfc0', 'hdfc0000231', 'hdfc bank limited', 'hdfc'])]

# Layout, groups of header words of which each must be found, words for each column role, in order.
LAYOUTS = [('schema_hdfc',
  [['narration', 'description'], ['withdrawal amt', 'withdrawal'], ['deposit amt', 'deposit'], ['closing balance', 'balance']],
  {'txn_date': ['date', 'txn date'],
   'description': ['narration', 'description', 'particulars'],
   'cheque': ['chq./ref.no.', 'chq', 'ref.no', 'cheque'],
   'val_date': ['value dt', 'value date'],
   'debit': ['withdrawal amt.', 'withdrawal amt', 'withdrawal'],
   'credit': ['deposit amt.', 'deposit amt', 'deposit'],
   'balance': ['closing balance', 'balance']}),
 ('schema_b',
  [['cr/dr'], ['txn posted date']],
  {'serial': ['no.'],
   'txn_id': ['transaction\nid', 'transaction id', 'id'],
   'val_date': ['value date'],
   'posted_date': ['txn posted date'],
   'cheque': ['cheque no'],
   'description': ['description'],
   'cr_dr_flag': ['cr/dr'],
   'amount': ['transaction\namount', 'transaction amount', 'amount'],
   'balance': ['available\nbalance', 'available balance', 'balance']}),
 ('schema_a',
  [['txn date'], ['debit'], ['credit'], ['balance']],
  {'txn_date': ['txn date'],
   'val_date': ['value date'],
   'cheque': ['cheque no'],
   'description': ['description'],
   'branch': ['branch'],
   'debit': ['debit'],
   'credit': ['credit'],
   'balance': ['balance']})]

# Account fields and their patterns; case does not matter.
METADATA = {'Customer ID': '(?:customer\\s*(?:id|no|cif|number)|cust\\s*id)[.:\\s]+([A-Z0-9]{5,20})',
 'Branch Name': '(?:account\\s*branch|branch\\s*(?:name)?)[.:\\s]+([A-Za-z][A-Za-z .\\-]{2,50})',
 'Branch Code': '(?:branch\\s*code)[.:\\s]+([0-9]{2,10})',
 'IFSC Code': '(?:ifsc\\s*(?:code)?|rtgs/neft\\s*ifsc)[.:\\s]+([A-Z]{4}0[A-Z0-9]{6})',
 'MICR Code': '(?:micr\\s*(?:code)?)[.:\\s]+(\\d{9})',
 'Account Number': '(?:account\\s*(?:number|no|a/c\\s*no|ac\\s*no))[.:\\s]+([0-9]{8,20})',
 'Account Type': '(?:account\\s*type|product\\s*name)[.:\\s]+([A-Za-z0-9 \\-_/()]{3,40})',
 'Account Currency': '(?:account\\s*currency|currency)[.:\\s]+([A-Za-z]{3})',
 'Interest Rate': '(?:interest\\s*rate)[.:\\s]+([0-9.]+\\s*%\\s*p\\.?a\\.?)',
 'Statement Period': '(?:searched\\s*by|period|statement\\s*(?:period|from))[.:\\s]+(?:from\\s*)?(\\d{1,2}\\s+[A-Za-z]{3}\\s+\\d{4}\\s*(?:to|-)\\s*\\d{1,2}\\s+[A-Za-z]{3}\\s+\\d{4}|\\d{2}[/-]\\d{2}[/-]\\d{2,4}\\s*(?:to|-)\\s*\\d{2}[/-]\\d{2}[/-]\\d{2,4})',
 'Opening Balance': '(?:opening\\s*balance)[.:\\s]+(?:Rs\\.?\\s*)?(\\d[\\d,]*\\.\\d{2})',
 'Closing Balance': '(?:closing\\s*balance)[.:\\s]+(?:Rs\\.?\\s*)?(\\d[\\d,]*\\.\\d{2})',
 'Email': '(?:email\\s*(?:id)?)[.:\\s]+([\\w.\\-+]+@[\\w.\\-]+\\.[a-z]{2,})',
 'Mobile': '(?:mobile|phone|contact)[.:\\s]+(\\+?\\d[\\d \\-]{8,14})',
 'PAN': '\\b([A-Z]{5}\\d{4}[A-Z])\\b'}

# Confidence gate and default of each domain.
GATES = {"Transaction Mode": (0.55, "Other"), "Transaction Direction": (0.5, "Debit"), "Transaction Purpose": (0.75, "General Transfer"), "Bank / Institution": (0.65, "Not Mentioned")}
