"""Reports, requests, traffic analytics, table maintenance, chats and enrichment."""
