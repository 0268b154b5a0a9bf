"""Word lists, source tiers and weights that results depend on.

Everything in this module is data that must have exactly these values and order.
"""

# Relevance keywords per source, matched as substrings of lower-cased text.
CODE_REPO_KEYWORDS = [
    "chip", "gpu", "memory", "bandwidth", "cuda", "hardware", "capacity", "shortage", "supply", "hbm", "nvlink",
    "infiniband", "network", "bottleneck", "latency", "throughput", "oom", "out of memory", "allocation", "driver",
    "firmware", "nvme", "pcie", "interconnect", "cluster", "topology", "fabric", "tsmc", "nvidia", "amd", "intel",
    "a100", "h100", "h200", "b200", "mi300", "tpu", "trainium", "inferentia", "wafer", "node", "process",
]
FORUM_KEYWORDS = [
    "semiconductor", "chip", "fab", "foundry", "tsmc", "asml", "nvidia", "amd", "hbm", "memory", "packaging",
    "cowos", "euv", "lithography", "supply chain", "shortage", "wafer", "ai hardware", "gpu", "accelerator",
    "bottleneck", "export control", "chips act", "samsung", "sk hynix", "sic", "gan", "substrate", "abf",
    "geopolit", "taiwan", "china", "intel",
]
FEED_KEYWORDS = [
    "semiconductor", "chip", "fab", "foundry", "TSMC", "ASML", "NVIDIA", "AMD", "Intel", "HBM", "memory",
    "packaging", "CoWoS", "EUV", "lithography", "supply chain", "shortage", "capacity", "wafer", "AI hardware",
    "GPU", "accelerator", "bottleneck", "geopolit", "export control", "CHIPS Act", "Samsung", "SK Hynix",
    "power semiconductor", "SiC", "GaN", "substrate", "ABF", "gallium", "germanium", "antimony", "indium",
    "rhenium", "hafnium", "tungsten", "rare earth", "dysprosium", "terbium", "neodymium", "NdPr", "NdFeB",
    "scandium", "cobalt", "lithium", "graphite anode", "natural graphite", "manganese sulphate",
    "nickel sulphate", "battery grade", "LFP", "NMC", "LMFP", "high purity quartz", "Spruce Pine",
    "silicon metal", "polysilicon", "neon gas", "hydrofluoric acid", "palladium", "fluorspar", "copper",
    "zinc concentrate", "alumina", "bauxite", "uranium", "LNG", "metallurgical coal", "coking coal", "helium",
    "potash", "phosphate", "urea", "sulphur", "sulfur", "cocoa", "robusta coffee", "critical mineral", "mining",
    "concentrate", "smelter", "refinery", "inventory",
]
PATENT_KEYWORDS = [
    "extreme ultraviolet", "EUV", "CoWoS", "HBM", "high bandwidth memory", "advanced packaging", "chiplet",
    "3D stacking", "gate-all-around", "silicon carbide", "gallium nitride", "ABF substrate", "supply chain",
    "sole source", "single source",
]
JOB_KEYWORDS = [
    "semiconductor", "chip", "fab", "process engineer", "equipment engineer", "lithography", "euv", "etch", "cvd",
    "ald", "cmp", "wafer", "packaging", "hbm", "cowos", "advanced packaging", "sic", "gan", "supply chain",
    "sourcing", "procurement", "supplier", "export control", "taiwan", "foundry", "tsmc", "asml", "photoresist",
    "epitaxy", "deposition",
]

# Filing forms and the terms whose surroundings make the filing snippet.
FILING_FORMS = ["8-K", "10-K", "10-Q"]
FILING_TERMS = [
    "supply chain", "shortage", "single source", "sole source", "concentration risk", "geopolitical",
    "export control", "EAR", "semiconductor", "foundry", "wafer", "packaging", "HBM", "Taiwan", "China", "TSMC",
    "ASML", "manufacturing capacity", "raw material", "critical material", "lead time",
]

# Evidence terms, matched as substrings.
RISK_TERMS = [
    "shortage", "delay", "disruption", "bottleneck", "constrained", "sole source", "single source",
    "export control", "ban", "restriction", "sanctions", "tariff", "capacity constraint", "lead time", "backlog",
    "allocation", "rationing",
]
MITIGATING_TERMS = [
    "expansion", "new fab", "alternative supplier", "qualification", "diversif", "investment",
    "capacity increase", "second source", "partnership",
]

# Uid prefix of an evidence line -> displayed source, first match wins.
SOURCE_CLASSES = [
    ("github:", "GitHub"), ("arxiv:", "arXiv"), ("hn:", "Hacker News"), ("edgar:", "SEC EDGAR"),
    ("rss_nyt", "NYT"), ("rss_reuters", "Reuters"), ("rss_ap", "AP"), ("rss_washpost", "WashPost"),
    ("rss_wsj", "WSJ"), ("rss_", "RSS"), ("jobs", "Job Posting"), ("uspto:", "USPTO"), ("reddit:", "Reddit"),
]

# Weights of the nine stress sub-scores, with their report labels.
STRESS_WEIGHTS = {
    "supply_growth_score": 0.15,
    "demand_growth_score": 0.15,
    "inventory_depletion_score": 0.15,
    "geographic_concentration_score": 0.15,
    "refining_concentration_score": 0.10,
    "geopolitical_risk_score": 0.10,
    "export_restriction_score": 0.10,
    "replacement_difficulty_score": 0.05,
    "production_lead_time_score": 0.05,
}
STRESS_LABELS = {
    "supply_growth_score": "Supply Growth (15%)",
    "demand_growth_score": "Demand Growth (15%)",
    "inventory_depletion_score": "Inventory Depletion (15%)",
    "geographic_concentration_score": "Geographic Concentration (15%)",
    "refining_concentration_score": "Refining Concentration (10%)",
    "geopolitical_risk_score": "Geopolitical Risk (10%)",
    "export_restriction_score": "Export Restrictions (10%)",
    "replacement_difficulty_score": "Replacement Difficulty (5%)",
    "production_lead_time_score": "Production Lead Time (5%)",
}

# Outlook phrases in match order, then word families.
OUTLOOKS = ["bearish", "neutral", "bullish"]
OUTLOOK_PHRASES = [
    ("very bearish", "bearish"), ("strongly bearish", "bearish"), ("negative", "bearish"),
    ("slightly bearish", "bearish"), ("mildly bearish", "bearish"), ("tight", "bearish"),
    ("very bullish", "bullish"), ("strongly bullish", "bullish"), ("positive", "bullish"),
    ("slightly bullish", "bullish"), ("mildly bullish", "bullish"), ("constructive", "bullish"),
    ("flat", "neutral"), ("stable", "neutral"), ("mixed", "neutral"), ("balanced", "neutral"),
]
BEARISH_WORDS = ["bear", "short", "deficit", "constrain", "shortage"]
BULLISH_WORDS = ["bull", "surplus", "ease", "recover"]
TIGHT_WORDS = ["tight", "unanim", "strong", "clear"]
CONTESTED_WORDS = ["contest", "sharp", "disagree"]

# Suffixes tried, in order, to close a truncated JSON object.
JSON_REPAIRS = ["", "}", "}}", '}"}', "]}"]

# Country name -> ISO 3166 alpha-3 code for the map.
COUNTRY_ISO3 = {
    "Taiwan": "TWN", "Japan": "JPN", "United States": "USA", "South Korea": "KOR", "Netherlands": "NLD",
    "China": "CHN", "Germany": "DEU", "Switzerland": "CHE", "Ireland": "IRL", "Singapore": "SGP",
    "Malaysia": "MYS", "Israel": "ISR", "Australia": "AUS", "India": "IND", "Vietnam": "VNM", "Thailand": "THA",
    "Philippines": "PHL", "United Kingdom": "GBR", "France": "FRA", "Belgium": "BEL", "Finland": "FIN",
}

# Forum and feed tiers.
FORUM_TIERS = {
    "chipdesign": 1, "semiconductors": 1, "SecurityAnalysis": 2, "hardware": 2, "MachineLearning": 2,
    "singularity": 2, "StockMarket": 3,
}
FEED_TIERS = {
    "semianalysis": 1, "ieee_spectrum": 1, "eetimes": 1, "tomshardware": 2, "anandtech": 2, "thechipletter": 1,
    "semiconductor_eng": 1, "wikichip_news": 1, "edn_network": 2, "nyt_technology": 3, "nyt_business": 3,
    "nyt_economy": 3, "reuters_tech": 3, "reuters_business": 3, "ap_technology": 3, "washpost_tech": 3,
    "wsj_markets": 3, "mining_com": 2, "reuters_commodities": 2,
}
JOB_FEED_TIERS = {"semiconductor": 1, "hardware": 2, "embedded": 2, "chip": 1, "engineering": 2, "manufacturing": 1}

# Sentinel layers of the alert ledger.
COVERAGE_LAYER = 4
REVIEW_SENTINEL = 98
TIER1_SENTINEL = 99

# Tracked commodities as (name, sector, unit, importance, search aliases); list order breaks rank ties.
COMMODITIES = [
    ("Gallium", "Critical Minerals", "kg", 5, ["gallium", "gallium metal", "Ga"]),
    ("Germanium", "Critical Minerals", "kg", 5, ["germanium", "GeO2", "germanium dioxide"]),
    ("Antimony", "Critical Minerals", "t", 4, ["antimony", "antimony trioxide", "Sb"]),
    ("Indium", "Critical Minerals", "kg", 4, ["indium", "ITO", "indium tin oxide"]),
    ("Rhenium", "Critical Minerals", "kg", 4, ["rhenium", "superalloy", "Re"]),
    ("Hafnium", "Critical Minerals", "kg", 5, ["hafnium", "HfO2", "hafnium oxide"]),
    ("Tungsten", "Critical Minerals", "t", 4, ["tungsten", "tungsten carbide", "WC", "wolfram"]),
    ("Dysprosium", "Rare Earths", "kg", 5, ["dysprosium", "heavy rare earth", "HREE", "Dy"]),
    ("Terbium", "Rare Earths", "kg", 5, ["terbium", "Tb"]),
    ("NdPr", "Rare Earths", "t", 5, ["neodymium", "praseodymium", "NdPr", "rare earth magnet", "NdFeB"]),
    ("Scandium", "Rare Earths", "kg", 3, ["scandium", "Sc", "scandium oxide"]),
    ("Cobalt", "Battery", "t", 4, ["cobalt", "DRC cobalt", "cobalt sulfate", "Co"]),
    ("Lithium Carbonate", "Battery", "t", 5, ["lithium carbonate", "lithium hydroxide", "lithium", "LCE", "Li"]),
    ("Graphite (Natural)", "Battery", "t", 4, ["natural graphite", "graphite anode", "spherical graphite", "graphite"]),
    ("Manganese Sulphate", "Battery", "t", 3,
     ["manganese sulphate", "manganese sulfate", "HPMSM", "high purity manganese", "manganese"]),
    ("Nickel Sulphate", "Battery", "t", 4,
     ["nickel sulphate", "nickel sulfate", "battery nickel", "Class I nickel", "nickel"]),
    ("High Purity Quartz", "Semiconductor", "t", 5,
     ["high purity quartz", "HPQ", "quartz crucible", "fused silica", "Spruce Pine"]),
    ("Silicon Metal", "Semiconductor", "t", 4, ["silicon metal", "polysilicon", "semiconductor silicon", "Si metal"]),
    ("Neon", "Semiconductor", "m3", 5, ["neon gas", "high purity neon", "neon", "semiconductor gas"]),
    ("Palladium", "Semiconductor", "troy oz", 4, ["palladium", "PGM", "platinum group metal", "Pd"]),
    ("Hydrofluoric Acid", "Semiconductor", "t", 5,
     ["hydrofluoric acid", "HF acid", "hydrogen fluoride", "HF", "etch chemical"]),
    ("Copper", "Base Metals", "t", 5, ["copper", "copper concentrate", "COMEX copper", "copper cathode", "Cu"]),
    ("Zinc Concentrate", "Base Metals", "t", 3, ["zinc concentrate", "zinc", "zinc smelter", "Zn"]),
    ("Alumina", "Base Metals", "t", 3, ["alumina", "aluminum oxide", "bauxite", "Al2O3", "aluminium oxide"]),
    ("Fluorspar", "Base Metals", "t", 4, ["fluorspar", "fluorite", "CaF2", "acid spar", "fluorite ore"]),
    ("Uranium", "Energy/Industrial", "lb U3O8", 5, ["uranium", "U3O8", "yellowcake", "uranium oxide", "nuclear fuel"]),
    ("LNG", "Energy/Industrial", "MMBtu", 4, ["LNG", "liquefied natural gas", "natural gas", "LNG terminal", "LNG tanker"]),
    ("Metallurgical Coal", "Energy/Industrial", "t", 4,
     ["metallurgical coal", "coking coal", "met coal", "hard coking coal", "HCC"]),
    ("Helium", "Energy/Industrial", "mcf", 4, ["helium", "helium supply", "liquid helium", "He"]),
    ("Potash", "Fertilizer", "t", 4, ["potash", "MOP", "muriate of potash", "KCl", "potassium chloride"]),
    ("Phosphate Rock", "Fertilizer", "t", 4, ["phosphate rock", "phosphate", "phosphoric acid", "DAP", "MAP"]),
    ("Urea", "Fertilizer", "t", 3, ["urea", "nitrogen fertilizer", "urea price", "ammonia", "AN fertilizer"]),
    ("Sulfur", "Fertilizer", "t", 3, ["sulfur", "sulphur", "elemental sulfur", "sulfuric acid"]),
    ("Cocoa", "Food", "t", 2, ["cocoa", "cacao", "cocoa butter", "cocoa beans", "chocolate"]),
    ("Robusta Coffee", "Food", "bags", 2,
     ["robusta coffee", "coffee robusta", "coffee futures", "robusta", "Vietnam coffee"]),
]
