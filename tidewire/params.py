"""Job parameters. Every threshold that defines a result lives here."""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values -----------------------------------------------------------
LOCAL_ZONE = "Asia/Shanghai"
UNKNOWN = "未知"

# provider, model, price in and price out per million tokens
PRICES = [
    ("deepseek", "deepseek-chat", 2.0, 3.0),
    ("deepseek", "deepseek-reasoner", 2.0, 3.0),
    ("deepseek", "default", 2.0, 3.0),
    ("qwen", "qwen-max", 6.0, 24.0),
    ("qwen", "qwen-plus", 0.8, 2.0),
    ("qwen", "qwen-turbo", 0.3, 0.6),
    ("qwen", "default", 6.0, 24.0),
]
FALLBACK_PRICE = (1.0, 2.0)
DEFAULT_PROVIDER = "deepseek"
DEFAULT_MODELS = {"deepseek": "deepseek-chat", "qwen": "qwen-plus"}

REGION_VALUES = ["国内", "国外", "未知"]
# layer names a response may carry -> stored layer
LAYER_ALIASES = {
    "金融政策监管": "金融政策监管",
    "金融经济": "金融经济",
    "金融大模型技术": "金融大模型技术",
    "金融科技应用": "金融科技应用",
    "政治": "金融政策监管",
    "经济": "金融经济",
    "金融科技": "金融科技应用",
    "未知": "未知",
}
# codes found in old rows -> stored value
REGION_CODES = {"DOMESTIC": "国内", "FOREIGN": "国外", "UNKNOWN": "未知"}
LAYER_CODES = {
    "POLITICS": "金融政策监管",
    "ECONOMY": "金融经济",
    "FINTECH": "金融科技应用",
    "FINTECH_AI": "金融大模型技术",
    "UNKNOWN": "未知",
}
LENIENT_LAYER = "金融大模型技术"

# settings shown when nothing is stored
DEFAULT_SETTINGS = {
    "report_topn": "5",
    "confidence_threshold": "0.6",
    "min_content_len": "120",
    "crawl_concurrency_rss": "10",
    "crawl_concurrency_web": "2",
    "llm_timeout_sec": "90",
    "llm_retries": "2",
    "smtp_host": "smtp.163.com",
    "smtp_port": "465",
    "mail_batch_limit": "50",
    "mail_rate_limit_per_sec": "1",
    "wordcloud_cache_ttl": "86400",
    "primary_color": "#2563eb",
    "secondary_color": "#1e4976",
    "accent_color": "#f59e0b",
    "provider_deepseek": "deepseek",
    "provider_qwen": "qwen",
}
# ---- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class Params:
    zone: str = LOCAL_ZONE
    report_topn: int = 5
    confidence_threshold: float = 0.6
    min_content_len: int = 120
    attachment_max_items: int = 500
    title_max: int = 500
    fact_min_len: int = 10
    stored_fact_min_len: int = 30
    model_limit: int = 64000
    budget: float = 0.7
    prompt_block_items: int = 20
    overlap_chars: int = 200
    max_chunks: int = 8
    long_text_strategy: str = "summary_then_extract"
    hamming_max: int = 3
    keyword_min_freq: int = 2
    keyword_few_articles: int = 10
    keyword_max: int = 100
    keyword_similarity: float = 0.8
    mail_batch: int = 50
    mail_rate: float = 1.0
    retry_base_sec: float = 2.0
    retry_max: int = 2
    lookback_hours: int = 24
    failures_to_switch: int = 3
    switch_hours: int = 1
    prefs_per_user: int = 5
    articles_keep_days: int = 180
    delivery_keep_days: int = 90
    facts_per_article: int = 8
    opinions_per_article: int = 5

    @property
    def token_budget(self) -> int:
        return int(self.model_limit * self.budget)


DEFAULTS = Params()
