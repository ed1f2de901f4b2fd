"""Schemas of the model tables and their integrity rules."""

from __future__ import annotations

from dataclasses import dataclass

BANK_DETAILS = (
    "struct<beneficiary_name:string,bank_name:string,account_number:string,"
    "iban:string,swift:string,bank_address:string>"
)
ISSUE = (
    "struct<code:string,field:string,severity:string,category:string,message:string,"
    "expected:string,actual:string,line_number:int>"
)

# Column lists in the form `DataFrameReader.schema` takes.
TABLES: dict[str, str] = {
    "documents": (
        "id long, filename string, original_filename string, file_path string, file_hash string,"
        "file_size long, mime_type string, status string, error_message string, version int,"
        "is_latest boolean, previous_version_id long, page_count int, company_key string,"
        "metadata map<string,string>, created_at timestamp_ntz, updated_at timestamp_ntz,"
        "indexed_at timestamp_ntz"
    ),
    "doc_pages": (
        "id long, doc_id long, page_no int, page_type string, type_confidence double, text string,"
        "text_length int, image_path string, image_hash string, metadata map<string,string>"
    ),
    "doc_chunks": (
        "id long, doc_id long, page_id long, chunk_index int, chunk_text string, chunk_size int,"
        "start_char int, end_char int, metadata map<string,string>"
    ),
    "invoices": (
        "id long, doc_id long, invoice_no string, invoice_date date, due_date date,"
        "seller_name string, buyer_name string, company_key string, currency string,"
        "total_amount double, subtotal double, tax_amount double, discount_amount double,"
        "total_quantity double, quality_score double, confidence double,"
        "template_confidence double, parser_version string, template_id string,"
        f"parsing_status string, bank_details {BANK_DETAILS}, is_latest boolean,"
        "created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "invoice_items": (
        "id long, invoice_id long, line_number int, item_name string, description string,"
        "hs_code string, unit string, brand string, model string, quantity double,"
        "unit_price double, total_price double, row_type string, matched_material_id string"
    ),
    "audit_results": (
        "id long, invoice_id long, trace_id string, status string, audit_type string,"
        f"issues array<{ISSUE}>, processing_time double, confidence double,"
        "created_at timestamp_ntz"
    ),
    "chat_sessions": (
        "session_id string, title string, status string, company_key string,"
        "active_doc_ids array<long>, active_invoice_ids array<long>,"
        "conversation_summary string, summary_message_count int, total_tokens int,"
        "max_context_tokens int, created_at timestamp_ntz, updated_at timestamp_ntz,"
        "last_message_at timestamp_ntz"
    ),
    "chat_messages": (
        "id long, session_id string, role string, content string, message_type string,"
        "token_count int, created_at timestamp_ntz"
    ),
    "memory_facts": (
        "session_id string, fact_type string, key string, value string, confidence double,"
        "related_doc_ids array<long>, access_count int, created_at timestamp_ntz,"
        "updated_at timestamp_ntz, expires_at timestamp_ntz"
    ),
    "company_templates": (
        "template_id string, company_name string, company_key string,"
        "detection_patterns array<string>, field_patterns map<string,string>, item_pattern string"
    ),
    "item_price_history": (
        "item_name_normalized string, hs_code string, seller_name string, invoice_id long,"
        "invoice_date date, quantity double, unit_price double, currency string,"
        "material_id string"
    ),
    "materials": (
        "id string, name string, normalized_name string, hs_code string, category string,"
        "unit string, description string, brand string, source_url string, origin_country string,"
        "origin_confidence string, evidence_text string, created_at timestamp_ntz,"
        "updated_at timestamp_ntz"
    ),
    "material_synonyms": "id long, material_id string, synonym string, language string",
    "company_documents": (
        "id long, company_key string, title string, document_type string, expiry_date date,"
        "issued_date date, issuer string, notes string, metadata map<string,string>"
    ),
    "reminders": (
        "id long, title string, message string, due_date date, is_done boolean,"
        "linked_entity_type string, linked_entity_id long"
    ),
    "inventory_items": (
        "id long, material_id string, quantity_on_hand double, avg_cost double,"
        "last_movement_date date"
    ),
    "stock_movements": (
        "id long, inventory_item_id long, movement_type string, quantity double,"
        "unit_cost double, reference string, notes string, movement_date date,"
        "created_at timestamp_ntz"
    ),
    "local_sales_invoices": (
        "id long, invoice_number string, customer_name string, sale_date date, subtotal double,"
        "tax_amount double, total_amount double, total_cost double, total_profit double,"
        "notes string"
    ),
    "local_sales_items": (
        "id long, sales_invoice_id long, inventory_item_id long, material_id string,"
        "description string, quantity double, unit_price double, cost_basis double,"
        "line_total double, profit double"
    ),
    "pdf_templates": (
        "id long, name string, template_type string, is_default boolean, is_active boolean,"
        "positions map<string,string>, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "generated_documents": (
        "id long, document_type string, template_id long, file_path string,"
        "created_at timestamp_ntz"
    ),
}

# Allowed words per column.
DOMAINS: dict[tuple[str, str], list[str]] = {
    ("documents", "status"): ["pending", "processing", "indexed", "failed"],
    ("doc_pages", "page_type"): [
        "invoice", "packing_list", "contract", "bank_form", "certificate", "cover_letter", "other",
    ],
    ("invoices", "parsing_status"): ["ok", "partial", "failed", "needs_review"],
    ("invoice_items", "row_type"): ["line_item", "header", "summary", "subtotal"],
    ("audit_results", "status"): ["PASS", "HOLD", "FAIL", "ERROR"],
    ("stock_movements", "movement_type"): ["in", "out", "adjust"],
    ("company_documents", "document_type"): [
        "license", "certificate", "permit", "insurance", "contract", "other",
    ],
    ("materials", "origin_confidence"): ["confirmed", "likely", "unknown"],
}


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_column: str = "id"
    on_delete: str = "cascade"


FOREIGN_KEYS: list[ForeignKey] = [
    ForeignKey("doc_pages", "doc_id", "documents"),
    ForeignKey("doc_chunks", "doc_id", "documents"),
    ForeignKey("documents", "previous_version_id", "documents", on_delete="set_null"),
    ForeignKey("invoice_items", "invoice_id", "invoices"),
    ForeignKey("audit_results", "invoice_id", "invoices"),
    ForeignKey("chat_messages", "session_id", "chat_sessions", "session_id"),
    ForeignKey("material_synonyms", "material_id", "materials"),
    ForeignKey("stock_movements", "inventory_item_id", "inventory_items"),
    ForeignKey("local_sales_items", "sales_invoice_id", "local_sales_invoices"),
]
