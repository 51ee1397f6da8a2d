"""Reports, payloads, ad-hoc SQL and the actions of a request."""
