"""Tables in and out: staging, adapters, schemas."""
