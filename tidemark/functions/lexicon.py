"""Sentiment weights, negators, keyword lists and title patterns."""

POSITIVE = {
    "surge": 2, "surges": 2, "soar": 2, "soars": 2, "rally": 2, "rallies": 2, "bullish": 2, "breakout": 2, "record": 1,
    "ath": 2, "all-time": 2, "adoption": 2, "partnership": 2, "partners": 1, "upgrade": 1, "approval": 3, "approved": 3,
    "etf": 1, "institutional": 2, "inflows": 2, "inflow": 2, "accumulate": 1, "accumulation": 1, "gains": 1, "jumps": 2,
    "jump": 1, "soaring": 2, "boom": 2, "outperform": 2, "milestone": 1, "launch": 1, "integrat": 1, "buyback": 2,
    "halving": 1, "moon": 2, "green": 1, "recover": 1, "recovery": 1, "rebound": 2, "optimism": 2, "confidence": 1,
    "backing": 1, "surged": 2, "climbs": 1, "climb": 1, "rise": 1, "rises": 1, "support": 1, "greenlight": 3, "unlock": 1,
    "staking": 1, "yield": 1,
}
NEGATIVE = {
    "crash": 3, "crashes": 3, "plunge": 3, "plunges": 3, "plummet": 3, "bearish": 2, "hack": 3, "hacked": 3, "exploit": 3,
    "exploited": 3, "dump": 2, "dumps": 2, "selloff": 2, "sell-off": 2, "lawsuit": 2, "sue": 2, "sec": 1, "ban": 2,
    "banned": 2, "liquidation": 2, "liquidated": 3, "collapse": 3, "collapses": 3, "rug": 3, "rugpull": 3, "delist": 3,
    "delisted": 3, "fud": 1, "fraud": 3, "scam": 3, "outflows": 2, "outflow": 2, "downturn": 2, "slump": 2, "tumble": 2,
    "tumbles": 2, "warning": 1, "warn": 1, "risk": 1, "fear": 1, "panic": 3, "capitulation": 3, "red": 1, "drop": 1,
    "drops": 1, "falls": 1, "fall": 1, "decline": 1, "loss": 1, "losses": 1, "bankruptcy": 3, "bankrupt": 3, "halt": 2,
    "halted": 2, "investigation": 2, "probe": 2, "arrest": 3, "charges": 2, "default": 3, "breach": 3, "stolen": 3,
    "freeze": 2, "frozen": 2, "concern": 1,
}
NEGATORS = ["no", "not", "never", "without", "denies", "denied", "avoid", "fails", "fail"]
KEYWORDS = {
    "BTCUSDT": ["bitcoin", "btc"], "ETHUSDT": ["ethereum", "eth", "ether"], "SOLUSDT": ["solana", "sol"],
    "BNBUSDT": ["binance coin", "bnb"], "XRPUSDT": ["ripple", "xrp"], "DOGEUSDT": ["dogecoin", "doge"],
    "ADAUSDT": ["cardano", "ada"], "AVAXUSDT": ["avalanche", "avax"], "LINKUSDT": ["chainlink", "link"],
    "LTCUSDT": ["litecoin", "ltc"], "BCHUSDT": ["bitcoin cash", "bch"], "DOTUSDT": ["polkadot"],
    "NEARUSDT": ["near protocol"], "APTUSDT": ["aptos", "apt"], "SUIUSDT": ["sui network", "sui"],
    "ARBUSDT": ["arbitrum", "arb"], "OPUSDT": ["optimism"], "INJUSDT": ["injective", "inj"],
    "ATOMUSDT": ["cosmos", "atom"], "FILUSDT": ["filecoin", "fil"], "TRXUSDT": ["tron", "trx"],
    "ETCUSDT": ["ethereum classic", "etc"], "UNIUSDT": ["uniswap", "uni"], "AAVEUSDT": ["aave"],
    "MKRUSDT": ["maker dao", "makerdao"], "FETUSDT": ["fetch.ai", "fetch ai"], "TAOUSDT": ["bittensor", "tao"],
    "SEIUSDT": ["sei network"], "TIAUSDT": ["celestia", "tia"], "WIFUSDT": ["dogwifhat", "wif"], "PEPEUSDT": ["pepe"],
    "ORDIUSDT": ["ordinals", "ordi"], "STXUSDT": ["stacks"], "IMXUSDT": ["immutable"], "GRTUSDT": ["the graph"],
    "RUNEUSDT": ["thorchain", "rune"], "JUPUSDT": ["jupiter"], "PYTHUSDT": ["pyth network"], "ENAUSDT": ["ethena", "ena"],
    "PENDLEUSDT": ["pendle"], "LDOUSDT": ["lido"], "WLDUSDT": ["worldcoin"], "ALGOUSDT": ["algorand", "algo"],
    "ICPUSDT": ["internet computer"], "HBARUSDT": ["hedera", "hbar"], "VETUSDT": ["vechain", "vet"],
    "SANDUSDT": ["the sandbox"], "MANAUSDT": ["decentraland", "mana"], "ARUSDT": ["arweave"],
}
TOKEN = r"[a-z0-9.\-]+"

# Patterns of announcement titles.
DATE = r"(20\d{2}-\d{2}-\d{2})"
TIME = r"(?i)(\d{1,2}):(\d{2})\s*\(?UTC\)?"
PAREN = r"\(([A-Z0-9]{2,12})\)"
PERP = r"\b([A-Z0-9]{2,15}(?:USDT|USDC|USD))\b(?:\s+\w+){0,3}\s+(?:Perpetual|perpetual)"
PAIR = r"\b([A-Z0-9]{2,12})/(USDT|USDC|USD|BTC|ETH)\b"
CONTRACT = r"\b([A-Z0-9]{2,15}(?:USDT|USDC))\b"

# Phrases that name the kind of a date in an announcement.
PHRASES = {
    "trading_start": [r"open(?:s)? trading", r"will (?:open|launch|list|begin trading)", r"trading (?:will )?(?:open|start|begin|go live)",
                      r"launch(?:es|ed)? .{0,40}perpetual", r"listing time", r"trading opens", r"available for trading", r"start(?:s)? trading"],
    "delisting": [r"will (?:be )?delist", r"delisting of", r"remove(?:s|d)? .{0,30}(?:trading pair|from)", r"cease trading", r"will be removed",
                  r"termination of", r"final settlement", r"close(?:s|d)? .{0,20}(?:contract|position)"],
    "suspension": [r"suspend", r"suspension", r"halt(?:ed|s)?", r"pause(?:d|s)? .{0,20}trading", r"cease deposits"],
}
