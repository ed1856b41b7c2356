"""Tables, rule dimensions, documents in XML, and how they are written."""
