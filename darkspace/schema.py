"""Column layouts."""

PACKETS = (
    "pindx long, saddr long, daddr long, proto int, sport int, dport int, p_chksum long, len int, ipid int, ttl int, ts_us long, "
    "tcp_flags int, tcp_seq long, tcp_ack long, tcp_win int, tcp_off int, ip_ihl int, ip_off int, payload binary"
)
#: Packet CSV, without a header; flow logs give the first eleven columns only.
PACKET_CSV = (
    "saddr long, daddr long, proto int, sport int, dport int, p_chksum long, len int, ipid int, ttl int, ts_date string, ts_epoch string, findx long, pindx long, "
    "tcp_flags int, tcp_seq long, tcp_ack long, tcp_win int, tcp_off int, ip_ihl int"
)
