"""The patterns that decide results, each whole and as it is matched, without regard to case.

SURVEY fixes them; its ids say which rule a pattern belongs to. The logic that uses them is in `text`, `figures`,
`disclosure` and `web`.
"""

# X28: scores of a text chunk
QUANT = (
    r"(\b[mgtkp]wh\b|megawatt[- ]?hours?|gigawatt[- ]?hours?|terawatt[- ]?hours?|kilowatt[- ]?hours?|"
    r"gigajoules?|terajoules?|petajoules?|\b[gtp]j\b|mmbtu|\b[mg]w\b|megawatts?|gigawatts?|"
    r"energy (?:consumption|consumed|use|usage)|electricity (?:consumption|consumed|use|usage|purchased)|"
    r"total energy|fuel consumption|gri 302|it load|data ?cent(?:er|re)s? capacity|"
    r"capital expenditures?|\bcapex\b|purchases? of property)"
)
UNIT_NUMBER = r"\d[\d,.]*\s?(?:[mgtk]wh|[gtp]j|mmbtu|[mg]w)\b|\((?:[mgtk]wh|[gtp]j|mmbtu)\)"
LARGE_NUMBER = r"\b\d{1,3}(?:,\d{3})+\b"
QUAL = (
    r"(launch\w*|ship(?:s|ped|ping)\b|introduc(?:ed|es|ing)\b|announc\w+|unveil\w*|breakthrough|first\b|record\b|"
    r"faster|x (?:faster|lower|more)|\d+x\b|open[- ]source|permit\w*|polic(?:y|ies)|regulat\w+|advoca\w+|"
    r"lobb\w+|legislat\w+|grid\b|nuclear|power plant|build(?:s|ing)? out|construct\w*|came online|online\b|"
    r"gigawatt-scale|ai factor(?:y|ies)|supercomputer|data cent(?:er|re)s?)"
)
BOILERPLATE = (
    r"(forward-looking statements?|safe harbor|cookie|privacy (?:policy|statement)|all rights reserved|"
    r"terms of (?:use|service)|subscribe|sign up|newsletter|share (?:on )?(?:twitter|linkedin|facebook)|"
    r"press contacts?|media contacts?|securities and exchange commission|risk factors|"
    r"no obligation to update)"
)

# P04: what a figure's quote says
STORAGE = (
    r"(energy[- ]storage|storage (?:products?|systems?|deployments?|capacity|solutions?)|battery storage|"
    r"megapacks?|powerwalls?|stationary storage|batter(?:y|ies)\b[^.]{0,60}\bdeploy|"
    r"deploy\w*\b[^.]{0,60}\b(?:storage|batter(?:y|ies)))"
)
SOLD = (
    r"\b(sold|sales? of (?:electricity|energy|power)|delivered to (?:customers|the grid)|"
    r"retail (?:sales|deliveries)|deliveries to customers|customers? (?:consumed|used))\b"
)
CONSUME = r"\b(consum\w*|usage|used|use of|purchased|electricity use|energy use)\b"
GENERATE = r"\b(generat\w*|produc\w*|output of our (?:plants|fleet))\b"
CAPEX = (
    r"(capital expenditures?|\bcapex\b|capital spending|capital investments?|purchases? of property|"
    r"property,? (?:plant,? )?and equipment|payments? (?:for|to acquire) (?:property|productive assets)|"
    r"additions to property|investments? in property)"
)
FINANCING = (
    r"\b(bonds?|notes? (?:due|offering)|senior notes|debt|offering|loans?|credit (?:facility|line)|"
    r"financing|raised?|raising|ipo|valuation|funding round|series [a-h]\b|convertible|private placement)\b"
)
DEAL = (
    r"\b(acqui(?:re|red|res|sition)|merger|deal|contract(?:s|ed)?|orders? (?:for|of|worth)|ordered|purchase agreement|"
    r"agreement to (?:buy|purchase)|turbines?|backlog|market (?:size|opportunity)|tam)\b"
)
FORWARD = (
    r"\b(plans?|planned|planning|expects?|expected|anticipat\w+|intends?|will (?:spend|invest|be)|to spend|"
    r"guidance|outlook|forecasts?|forecasted|projected|projection|budget(?:ed)?|targets?|targeting|"
    r"commit(?:s|ted|ment)?|up to|over the next|proposed|pledged?)\b"
)
RUN_RATE = r"\b(run[- ]rate|annuali[sz]ed|arr\b|valuation|valued at|bookings|backlog)\b"
FUTURE_CAPACITY = (
    r"\b(planned|will|expected|under construction|upcoming|to be (?:built|completed|online)|proposed|"
    r"announced plans?|plans? to|planning to|intends? to|next year|pipeline|contracted|secured|"
    r"by (?:the end of )?20\d\d|coming online|under development|in development|being (?:developed|built)|"
    r"under way|underway|in progress|forthcoming|pre-construction|broke ground|breaking ground|"
    r"future capacity|development pipeline)\b"
)
OPERATING = r"\b(operat\w*|online|on-line|in service|energi[sz]ed|running|live|installed|existing|currently|today|active)\b"
PLANNED_NEAR = (
    r"\b(planned|under (?:development|construction)|in development|pipeline|contracted|"
    r"announced|future|proposed|by 20\d\d|upcoming|to come online)\b"
)
TOTAL = r"\btotal\b"

# X23, X25, W15: footnotes, runs of values, scales
FOOTNOTE_SIGNS = "*†‡§¹²³⁴⁵⁶⁷⁸⁹"
FOOTNOTE_USED = r"(?<=[\w%)\]])(\*{1,3}|†|‡|§|[¹²³⁴⁵⁶⁷⁸⁹])"
UNLABELLED_RUN = (
    r"\(\s*(?:[kMGT]Wh|GJ|TJ|PJ|MJ|gigajoules?|megawatt[- ]hours?)\s*\)\s*"
    r"((?:(?:FY\s*)?\d[\d,]*(?:\.\d+)?\s+){1,}\d[\d,]*(?:\.\d+)?)\b"
)
TABLE_SCALE = r"(?:\(|\b)(?:in|amounts in|dollars in|\$ in|us\$ in|usd in|expressed in)\s+(thousands|millions|billions)\b"
INLINE_SCALE = r"\b(thousand|million|billion|bn|mn)\b|\$\s?\d[\d,.]*\s?[mbk]\b"

# X12: energy disclosures
REGISTRIES = ("cdp.net", "responsibilityreports.com")
LISTING_PATH = (
    r"/(?:sec-filings|filings|financial-information|financials|quarterly-results|annual-reports?|events|"
    r"news(?:room)?|press(?:-releases?|room)?|press-release|media(?:-center)?|blog|stories|articles?)(?:/|$)"
)
INVESTOR_ROOT = r"^/(?:investors?|ir)?/?$"
CONSUMPTION_CLAIM = (
    r"energy (?:use|usage|consumption|consumed)|electricity (?:use|usage|consumption|consumed)|"
    r"(?:k|m|g)wh (?:consumed|of electricity)|power (?:use|consumption)|scope ?2|\bghg\b|emissions? inventory"
)
DISCLOSURE_SIGNAL = (
    r"(?:impact|sustainab\w*|esg|climate|environmental|responsibility)[-_ ]?(?:report|data|appendix|disclosure|"
    r"index|databook|factbook|performance)|\bcdp\b|\bghg\b|scope[-_ ]?[12]\b|"
    r"energy[-_ ](?:use|usage|consumption|data)|electricity[-_ ](?:use|usage|consumption)|\b(?:k|m|g)wh\b|"
    r"data[-_ ]?(?:appendix|table|sheet)|\bgri[-_ ](?:index|content)|tcfd"
)
REPORT_PATH = r"^/(?:[a-z]{2}(?:[-_][a-z]{2})?/)?(?:impact|sustainability|esg|environment|climate|responsibility|corporate-responsibility)(?:/[^/]*)?/?$"
REPORT_PDF = r"impact|sustainab|\besg\b|\bcdp\b|climate|environment|emission|\bghg\b|energy"

# T06: candidates
ENERGY_HINT = r"impact|sustainab|\besg\b|environment|energy|climate|\bcdp\b|emission|carbon|\bghg\b|\bgri\b"
COMPACT_DATA = (
    r"(esg[-_ ]?data|data[-_ ]?(?:book|appendix|table|sheet|pack|center|centre|hub)|databook|factsheet|"
    r"fact[-_ ]sheet|performance[-_ ]data|\bkpis?\b|key[-_ ]metrics|\bgri\b|gri[-_ ]?index|\bsasb\b|\btcfd\b|"
    r"\bcdp\b|climate[-_ ]change[-_ ]response|\.csv\b|\.xlsx?\b|esg[-_ ]?index)"
)
BULKY_REPORT = r"(extended|full|complete|integrated|annual[-_ ]report|impact[-_ ]report|sustainability[-_ ]report)[^/]*\.pdf\b"

# X18: filings
ACCESSION = r"(?:^|[^0-9])([0-9]{10}-?[0-9]{2}-?[0-9]{6})(?:[^0-9]|$)"
FULL_SUBMISSION = r"^/Archives/edgar/data/[0-9]+/[0-9]{10}-[0-9]{2}-[0-9]{6}\.txt$"
FORM_WORDS = r"\b(10-?k|20-?f|40-?f|annual report)\b"
INLINE_MAIN = r"/[a-z][a-z0-9.]*-([0-9]{8})\.html?$"

# Pages that stand in for others, links to reports, and data that pages carry beside their markup (S18, S20, S09).
BLOCK_PAGE = (
    r"access denied|you don.t have permission to access|errors\.edgesuite\.net|attention required|just a moment\.\.\.|checking your browser|cf-browser-verification|"
    r"request rejected|pardon our interruption|are you a robot|captcha|temporarily offline|too many requests"
)
REPORT_LINK = (
    r"impact|sustainab|\besg\b|climate|environment|responsib|\bcdp\b|\bghg\b|emission|carbon|energy|tcfd|\bgri\b|data[-_ ]?(?:appendix|table|sheet|pack)|kpi"
)
FULL_EDITION = r"extended|full|complete|data|appendix|kpi|metrics|disclosure"
SUMMARY_EDITION = r"highlight|summary|brief|overview|executive|snapshot|infographic|fact[-_ ]?sheet"
LINK_YEAR = r"(?<!\d)(20[0-4]\d)(?!\d)"
SITE_WIDE_ISLAND = r"setting|config|site|i18n|locale|translation|\bnav|menu|footer|header|cookie|consent"
NO_PROSE = r"^(?:https?:|/|data:|#)|\.(?:png|jpe?g|svg|webp|gif|js|css|woff2?)(?:\?|$)"
COMPANY_ENTRY = r'href="(/Company/[a-z0-9\-]+)"[^>]*>\s*([^<]{2,200})<'
RECENT_BLOCK = r'(?s)class="most_recent_content_block"(.*?)(?:<h2|class="archived_report|$)'
RECENT_REPORT = r'href="(/Click/\d+)"[^>]*>\s*([^<]{0,120})<'
ARCHIVED_REPORT = r'href="(/HostedData/ResponsibilityReportArchive/[^"]+?_(\d{4})\.pdf)"'
