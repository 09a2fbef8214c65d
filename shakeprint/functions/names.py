"""Names of the codes that features hold, as small tables to join or look up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Registered names (IKEv2 parameters, TLS cipher suites, DTLS versions).
IKE_PAYLOADS = {33: "SA", 34: "KE", 39: "AUTH", 40: "Nonce", 41: "Notify", 43: "Vendor ID", 46: "Encrypted and Authenticated"}
IKE_NOTIFIES = {
    7: "INVALID_SYNTAX", 9: "INVALID_MESSAGE_ID", 11: "INVALID_SPI", 14: "NO_PROPOSAL_CHOSEN", 17: "INVALID_KE_PAYLOAD", 24: "AUTHENTICATION_FAILED",
    34: "SINGLE_PAIR_REQUIRED", 35: "NO_ADDITIONAL_SAS", 36: "INTERNAL_ADDRESS_FAILURE", 37: "FAILED_CP_REQUIRED", 38: "TS_UNACCEPTABLE", 39: "INVALID_SELECTORS",
    16388: "NAT_DETECTION_SOURCE_IP", 16389: "NAT_DETECTION_DESTINATION_IP", 16392: "HTTP_CERT_LOOKUP_SUPPORTED", 16404: "MULTIPLE_AUTH_SUPPORTED", 16418: "CHILDLESS_IKEV2_SUPPORTED", 16430: "IKEV2_FRAGMENTATION_SUPPORTED",
}
DTLS_VERSIONS = {65279: "DTLS 1.0", 65277: "DTLS 1.2", 65276: "DTLS 1.3"}
CIPHER_SUITES = {
    4865: "TLS_AES_128_GCM_SHA256", 4867: "TLS_CHACHA20_POLY1305_SHA256", 4866: "TLS_AES_256_GCM_SHA384",
    49195: "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256", 49199: "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", 52393: "TLS_ECDHE_ECDSA_WITH_CHACHA20_POLY1305_SHA256", 52392: "TLS_ECDHE_RSA_WITH_CHACHA20_POLY1305_SHA256",
    49196: "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384", 49200: "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384", 49162: "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA", 49161: "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA",
    49171: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA", 49172: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA", 156: "TLS_RSA_WITH_AES_128_GCM_SHA256", 157: "TLS_RSA_WITH_AES_256_GCM_SHA384", 47: "TLS_RSA_WITH_AES_128_CBC_SHA", 53: "TLS_RSA_WITH_AES_256_CBC_SHA",
}


def named(code: Column, names: dict[int, str]) -> Column:
    """The code's name; null for codes without one. The table is a literal, so nothing is joined."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), code.cast("int"))
